"""Event streams: windows with watermarks, and each key's state until its terminal event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by event time and type; works on a stream and on a table alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def until_terminal(events: DataFrame, terminal: str = "purchase") -> DataFrame:
    """(user_id, applied, terminal): events applied up to the first terminal one; later ones are ignored. For streams.

    Events of a key must reach the stream in order; inside a batch they are ordered by event_id.
    """

    def apply(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        applied, done = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for kind in rows["event_type"]:
            if done:
                break
            applied, done = applied + 1, kind == terminal
        state.update((applied, done))
        yield pd.DataFrame({"user_id": [key[0]], "applied": [applied], "terminal": [int(done)]})

    return events.groupBy("user_id").applyInPandasWithState(apply, "user_id long, applied long, terminal int", "applied long, done boolean", "update", "NoTimeout")


def first_statuses(events: DataFrame, key: str, tool: str, named: dict[str, str], silent: list[str], other: str = "using_tool", late: str | None = None) -> DataFrame:
    """events with their tool's status, each status once a key; tools not named share one status, silent ones have none.

    On a table one event of each status stays; on a stream the first to come, and ts with the delay `late` says when a
    key's statuses may be forgotten. A null tool has no status.
    """
    status = F.when(F.col(tool).isNull() | F.col(tool).isin(*silent), F.lit(None))
    for name, shown in named.items():
        status = status.when(F.col(tool) == name, shown)
    told = events.withColumn("status", status.otherwise(other)).where("status is not null")
    if late is None:
        return told.dropDuplicates([key, "status"])
    return told.withWatermark("ts", late).dropDuplicatesWithinWatermark([key, "status"])
