"""What is remembered of each user, as candidates come: an ordered fold by key with thresholds, as a table and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text
from ..streaming.keys import named, unnamed

# Least confidence at all, and to change or delete what is sensitive; the sensitive kinds.
LEAST, SAFETY = 0.80, 0.98
SENSITIVE = {"DIETARY_RESTRICTION"}
LONGEST_KEY, LONGEST_VALUE = 80, 255

MEMORY = "owner long, key string, kind string, value string, confidence double, active boolean, changed long"
CANDIDATE = ["owner", "key", "seq", "action", "kind", "value", "confidence"]


class Memory(NamedTuple):
    kind: str
    value: str
    confidence: float
    active: bool
    changed: int


def applied(old: Memory | None, seq: int, action: str, kind: str, value: str | None, confidence: float | None) -> Memory | None:
    """The memory after one candidate; one that is too unsure, or not sure enough for what is sensitive, changes nothing."""
    if confidence is None or not confidence >= LEAST:
        return old
    sensitive = old is not None and old.kind in SENSITIVE
    if action == "DELETE":
        if old is None or not old.active or (sensitive and confidence < SAFETY):
            return old
        return old._replace(active=False, changed=seq)
    value = " ".join((value or "").split())
    if not value or len(value) > LONGEST_VALUE:
        return old
    rounded = float(Decimal(repr(float(confidence))).quantize(Decimal("0.0001"), ROUND_HALF_UP))
    if old is None:
        return Memory(kind, value, rounded, True, seq)
    changes = old.value.lower() != value.lower() or old.kind != kind
    if changes and sensitive and confidence < SAFETY:
        return old
    return Memory(old.kind if sensitive and kind not in SENSITIVE else kind, value if changes else old.value, rounded if changes else max(old.confidence, rounded), True, seq)


def keyed(candidates: DataFrame) -> DataFrame:
    rows = candidates.select(*CANDIDATE).withColumn("key", text.collapsed(F.lower("key")))
    return rows.where((F.col("key") != "") & (F.length("key") <= LONGEST_KEY))


def remembered(candidates: DataFrame) -> DataFrame:
    """(owner, key, kind, value, confidence, active, changed) after all candidates (owner, key, seq, action, kind, value, confidence).

    Keys are lower case, white space collapsed in keys and values; a blank or overlong key or value is refused. Candidates of a key are taken in the order of seq. What a later one does depends
    on what was accepted before, so a key is folded by one task; sorted rows run through it with one memory at a time,
    whatever a key's length. Keys that only had refused candidates give no row; null owners are one owner, null keys are refused.
    """
    rows = keyed(candidates).repartition("owner", "key").sortWithinPartitions("owner", "key", "seq", "action", "value")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, memory = None, None
        for frame in frames:
            out = []
            for owner, key, seq, action, kind, value, confidence in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                if (owner, key) != at:
                    if memory is not None:
                        out.append((*at, *memory))
                    at, memory = (owner, key), None
                memory = applied(memory, seq, action, kind, value, confidence)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MEMORY.split(", ")])
        if memory is not None:
            yield pd.DataFrame([(*at, *memory)], columns=[c.split()[0] for c in MEMORY.split(", ")])

    return rows.mapInPandas(fold, MEMORY)


class Remembering(StatefulProcessor):
    """One key's memory in the state store; each batch gives the memory as it then is, if it changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "kind string, value string, confidence double, active boolean, changed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.memory.get()
        memory = before = Memory(*held) if held else None
        frame = pd.concat(list(rows)).sort_values(["seq", "action", "value"], kind="stable")
        for seq, action, kind, value, confidence in frame[CANDIDATE[2:]].astype(object).where(frame[CANDIDATE[2:]].notna(), None).itertuples(index=False):
            memory = applied(memory, seq, action, kind, value, confidence)
        if memory != before:
            self.memory.update(tuple(memory))
        yield pd.DataFrame([(*key, *memory)] if memory != before else [], columns=[c.split()[0] for c in MEMORY.split(", ")])

    def close(self) -> None:
        pass


def remembered_stream(candidates: DataFrame) -> DataFrame:
    """Changes of memories from a stream of candidates; those of a key must reach it in order. The last row of a key is its memory."""
    rows = keyed(candidates).withColumn("owner", named(F.col("owner"))).groupBy("owner", "key")
    out = rows.transformWithStateInPandas(statefulProcessor=Remembering(), outputStructType=MEMORY.replace("owner long", "owner string"), outputMode="Update", timeMode="None")
    return out.withColumn("owner", unnamed(F.col("owner"), "long"))
