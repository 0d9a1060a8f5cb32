"""What a client is told of an answering agent's events: one state machine a conversation, as a stream and as a table.

Events (conv_id, seq, kind, message_id, text, tools) come in the order of seq. Kinds:

- ``stage``: text names a stage; those in STAGES are told, others are not.
- ``chunk``: a part of a message. With tools, the message is a request for tools and may have no text for the user.
- ``update``: tools that ran, or a message (message_id, text) that may be the last.
- ``end``: the final message (message_id, text); everything must fit it.

Told (conv_id, seq, part, event, value): a first status, each tool's status once, the status before the first text once,
tokens, then either `completed` and `done`, or one `error`. Whatever follows is ignored, so a conversation has one end.
`seq` is that of the event that caused it, `part` its place beside others of the same event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .keys import named, unnamed

# Stages that are told and how, tools with a status of their own, and one without any.
STAGES = {"summarizing_context": "status", "generating_image": "status", "generated_image_ready": "generated_image", "image_generation_failed": "image_error"}
TOOL_STATUS = {"recipe_search": "searching_recipe_kb", "web_search": "searching_web"}
SILENT_TOOL = "generate_dish_image"
OTHER_STATUS = "using_tool"
FIRST, ANSWERING, COMPLETED = "thinking", "generating_answer", "completed"
# what an error says
REQUEST_WITH_TEXT, UNLIKE_FINAL, OTHER_MESSAGE, UNLIKE_UPDATE = "text in a tool request", "text differs from the final message", "text of another message", "update differs from the final message"

TOLD = "conv_id long, seq long, part int, event string, value string"
EVENTS = ["conv_id", "seq", "kind", "message_id", "text", "tools"]


def tool_statuses(tools: list[str]) -> list[str]:
    """Statuses of tools that were called, in their fixed order."""
    found = [status for name, status in TOOL_STATUS.items() if name in tools]
    return found + [OTHER_STATUS] * bool(set(tools) - set(TOOL_STATUS) - {SILENT_TOOL})


class Conversation(StatefulProcessor):
    """The machine with its state in the store: what was told, texts in order, and who wrote them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "begun boolean, answering boolean, ended boolean, update_id string, update_text string")
        self.statuses = handle.getMapState("statuses", "status string", "told boolean")
        self.requests = handle.getMapState("requests", "message_id string", "asked boolean")
        self.writers = handle.getMapState("writers", "message_id string", "wrote boolean")
        self.parts = handle.getListState("parts", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begun, answering, ended, update_id, update_text = self.at.get() or (False, False, False, None, None)
        out: list[tuple] = []
        if not ended:
            events = pd.concat(list(rows)).sort_values("seq", kind="stable")
            for seq, kind, message, text, tools in zip(*(events[c] for c in EVENTS[1:])):
                message, text = (None if pd.isna(x) else x for x in (message, text))
                tools = [] if tools is None else list(tools)
                told: list[tuple[str, str | None]] = []
                if not begun:
                    told.append(("status", FIRST))
                    begun = True
                if kind == "stage" and text in STAGES:
                    told.append((STAGES[text], text))
                elif kind in ("chunk", "update") and tools:
                    wrong = kind == "chunk" and self.writers.containsKey((message or "",))
                    if kind == "chunk":
                        self.requests.updateValue((message or "",), (True,))
                    if wrong:
                        told.append(("error", REQUEST_WITH_TEXT))
                        ended = True
                    else:
                        for status in tool_statuses(tools):
                            if not self.statuses.containsKey((status,)):
                                self.statuses.updateValue((status,), (True,))
                                told.append(("status", status))
                elif kind == "chunk" and text:
                    if self.requests.containsKey((message or "",)):
                        told.append(("error", REQUEST_WITH_TEXT))
                        ended = True
                    else:
                        if not answering:
                            told.append(("status", ANSWERING))
                            answering = True
                        self.writers.updateValue((message or "",), (True,))
                        self.parts.appendValue((text,))
                        told.append(("token", text))
                elif kind == "update" and text:
                    update_id, update_text = message, text
                elif kind == "end":
                    told += self._ended(message, text or "", answering, update_id, update_text)
                    ended = True
                out += [(key[0], seq, part, event, value) for part, (event, value) in enumerate(told)]
                if ended:
                    for state in (self.statuses, self.requests, self.writers, self.parts):
                        state.clear()  # only the end itself is remembered
                    break
            self.at.update((begun, answering, ended, update_id, update_text))
        yield pd.DataFrame(out, columns=["conv_id", "seq", "part", "event", "value"])

    def _ended(self, message, text, answering, update_id, update_text) -> list[tuple[str, str | None]]:
        written = "".join(p[0] for p in self.parts.get())
        writers = {k[0] for k in self.writers.keys()}
        done = [("status", COMPLETED), ("done", None)]
        if written and written != text:
            return [("error", UNLIKE_FINAL)]
        if message is not None and writers not in (set(), {message}):
            return [("error", OTHER_MESSAGE)]
        if update_id is not None and update_id == message and update_text != text:
            return [("error", UNLIKE_UPDATE)]
        if not written:
            return [("status", ANSWERING)] * (not answering) + [("token", text), *done]
        return done

    def close(self) -> None:
        pass


def told_stream(events: DataFrame) -> DataFrame:
    """What is told, from a stream of events; those of a conversation must reach it in order, inside a batch by seq.

    Needs a state store with several column families (RocksDB). The state of a conversation that has ended is one row.
    """
    rows = events.select(*EVENTS).withColumn("conv_id", named(F.col("conv_id"))).groupBy("conv_id")
    out = rows.transformWithStateInPandas(statefulProcessor=Conversation(), outputStructType=TOLD.replace("conv_id long", "conv_id string"), outputMode="Append", timeMode="None")
    return out.withColumn("conv_id", unnamed(F.col("conv_id"), "long"))


def told(events: DataFrame) -> DataFrame:
    """The same of a whole table, by windows over each conversation; null texts and tools are empty, null ids one message."""
    order = Window.partitionBy("conv_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    of_message = Window.partitionBy("conv_id", "_message").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    tools, text = F.coalesce("tools", F.array().cast("array<string>")), F.coalesce("text", F.lit(""))
    e = events.select(*EVENTS).withColumn("tools", tools).withColumn("text", text).withColumn("_message", F.coalesce("message_id", F.lit("")))
    asks = (F.col("kind") == "chunk") & (F.size("tools") > 0)
    writes = (F.col("kind") == "chunk") & (F.size("tools") == 0) & (F.col("text") != "")
    e = e.withColumn("_asks", asks).withColumn("_writes", writes)
    had = lambda c: F.coalesce(F.max(c).over(of_message), F.lit(False))
    e = e.withColumn("_wrong", (F.col("_asks") & had("_writes")) | (F.col("_writes") & had("_asks")))
    # the first end or fault of a conversation is its last event
    last = F.min(F.when(F.col("_wrong") | (F.col("kind") == "end"), F.col("seq"))).over(Window.partitionBy("conv_id"))
    e = e.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("seq") <= F.col("_last")))
    e = e.withColumn("_writes", F.col("_writes") & ~F.col("_wrong")).withColumn("_nth", F.row_number().over(order))
    statuses = F.filter(F.array(*(F.when(F.array_contains("tools", name), status) for name, status in TOOL_STATUS.items()), F.when(F.size(F.array_except("tools", F.array(*map(F.lit, (*TOOL_STATUS, SILENT_TOOL))))) > 0, OTHER_STATUS)), lambda x: x.isNotNull())
    calls = F.when(F.col("kind").isin("chunk", "update") & ~F.col("_wrong"), statuses).otherwise(F.array().cast("array<string>"))
    e = e.withColumn("_calls", calls).withColumn("_said", F.array_distinct(F.flatten(F.collect_list("_calls").over(before))))
    e = e.withColumn("_answers", F.coalesce(F.max("_writes").over(before), F.lit(False)))
    # what the end is held against is put together once, at the end, so no event carries the text before it
    written = e.where("_writes").groupBy(F.col("conv_id").alias("_conv")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("_written"), F.collect_set("_message").alias("_writers"))
    update = e.where("kind = 'update' and size(tools) = 0 and text <> ''").groupBy(F.col("conv_id").alias("_conv_u")).agg(F.max_by(F.struct("message_id", "text"), "seq").alias("_update"))
    e = e.join(written, F.col("conv_id") == F.col("_conv"), "left").join(update, F.col("conv_id") == F.col("_conv_u"), "left").withColumn("_written", F.coalesce("_written", F.lit("")))
    one = lambda event, value: F.array(F.struct(F.lit(event).alias("event"), (value if isinstance(value, Column) else F.lit(value).cast("string")).alias("value")))
    none = F.filter(one("", ""), lambda x: F.lit(False))
    if_ = lambda condition, rows: F.when(condition, rows).otherwise(none)
    end = (
        F.when((F.col("_written") != "") & (F.col("_written") != F.col("text")), one("error", UNLIKE_FINAL))
        .when(F.col("message_id").isNotNull() & (F.size("_writers") > 0) & ~((F.size("_writers") == 1) & F.array_contains("_writers", F.col("message_id"))), one("error", OTHER_MESSAGE))
        .when((F.col("_update.message_id") == F.col("message_id")) & (F.col("_update.text") != F.col("text")), one("error", UNLIKE_UPDATE))
        .otherwise(F.concat(if_(F.col("_written") == "", F.concat(if_(~F.col("_answers"), one("status", ANSWERING)), one("token", F.col("text")))), one("status", COMPLETED), one("done", None)))
    )
    stage = none
    for name, event in STAGES.items():
        stage = F.when(F.col("text") == name, one(event, name)).otherwise(stage)
    main = (
        F.when(F.col("_wrong"), one("error", REQUEST_WITH_TEXT))
        .when(F.col("kind") == "end", end)
        .when(F.col("_writes"), F.concat(if_(~F.col("_answers"), one("status", ANSWERING)), one("token", F.col("text"))))
        .when(F.col("kind") == "stage", stage)
        .otherwise(F.transform(F.array_except("_calls", "_said"), lambda s: F.struct(F.lit("status").alias("event"), s.alias("value"))))
    )
    rows = F.concat(if_(F.col("_nth") == 1, one("status", FIRST)), main)
    return e.select("conv_id", "seq", F.posexplode(rows).alias("part", "row")).select("conv_id", "seq", "part", "row.event", "row.value")
