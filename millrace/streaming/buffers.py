"""Buffers that hold what was put in for a while: items expire after a time, and the oldest makes room in a full buffer."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .keys import named, unnamed

TTL_SECONDS, CAPACITY = 600, 32
ENDS = "key long, item long, put timestamp, fate string, at timestamp"


def fates(puts: DataFrame, ttl: int = TTL_SECONDS, capacity: int = CAPACITY) -> DataFrame:
    """(key, item, put, fate, at) of each put (key, item, ts): `evicted` by the put that found the buffer full, or `expired`.

    An item is there until more than ttl seconds have passed. Puts are ordered by ts, then item. Eviction takes the
    oldest, so an item goes at the capacity-th put behind it if that comes in time: all between are younger and
    still there. Repeated items are items of their own; null keys are one buffer; a put without a time never was.
    """
    order = Window.partitionBy("key").orderBy("ts", "item")
    full = F.lead("ts", capacity).over(order)
    over = F.col("ts") + F.make_dt_interval(secs=F.lit(ttl))
    at = puts.where("ts is not null").select("key", "item", "ts", full.alias("_full"), over.alias("_over"))
    evicted = F.coalesce(F.col("_full") <= F.col("_over"), F.lit(False))
    return at.select("key", "item", F.col("ts").alias("put"), F.when(evicted, "evicted").otherwise("expired").alias("fate"), F.when(evicted, F.col("_full")).otherwise(F.col("_over")).alias("at"))


def held(puts: DataFrame, at: str, ttl: int = TTL_SECONDS, capacity: int = CAPACITY) -> DataFrame:
    """(key, item, put): what the buffers hold at a time, puts of that time included."""
    now = F.lit(at).cast("timestamp")
    return fates(puts.where(F.col("ts") <= now), ttl, capacity).where((F.col("fate") == "expired") & (F.col("at") >= now)).select("key", "item", "put")


class Buffer(StatefulProcessor):
    """One key's buffer: items by order of their put in a map, with a timer for the next to expire."""

    def __init__(self, ttl: int, capacity: int):
        self.ttl, self.capacity = ttl, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "ts timestamp, item long", "n int")

    def _sorted(self) -> list[tuple]:
        return sorted((k[0], k[1], v[0]) for k, v in self.items.iterator())

    def _timer(self, there: list[tuple]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if there:
            self.handle.registerTimer(int((pd.Timestamp(there[0][0]).timestamp() + self.ttl) * 1000) + 1)

    def _expire(self, key, there: list[tuple], now, out: list[tuple]) -> list[tuple]:
        over = timedelta(seconds=self.ttl)
        while there and now - there[0][0] > over:
            ts, item, n = there.pop(0)
            out += [(key[0], item, ts, "expired", ts + over)] * n
            self.items.removeKey((ts, item))
        return there

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        there, out = self._sorted(), []
        size = sum(n for *_, n in there)
        puts = pd.concat(list(rows)).dropna(subset=["ts"]).sort_values(["ts", "item"], kind="stable")
        for ts, item in zip(puts["ts"].dt.to_pydatetime(), puts["item"]):
            self._expire(key, there, ts, out)
            size = sum(n for *_, n in there)
            if size >= self.capacity:
                oldest, first, n = there[0]
                out.append((key[0], first, oldest, "evicted", ts))
                there[:1] = [(oldest, first, n - 1)] if n > 1 else []
                self.items.updateValue((oldest, first), (n - 1,)) if n > 1 else self.items.removeKey((oldest, first))
            if there and there[-1][:2] == (ts, item):
                there[-1] = (ts, item, there[-1][2] + 1)
            else:
                there.append((ts, item, 1))
            self.items.updateValue((ts, int(item)), (there[-1][2],))
        self._timer(there)
        yield pd.DataFrame(out, columns=["key", "item", "put", "fate", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        now = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms").to_pydatetime()
        self._timer(self._expire(key, self._sorted(), now, out))
        yield pd.DataFrame(out, columns=["key", "item", "put", "fate", "at"])

    def close(self) -> None:
        pass


def fates_stream(puts: DataFrame, ttl: int = TTL_SECONDS, capacity: int = CAPACITY, late: str = "0 seconds") -> DataFrame:
    """The fates of a stream of puts (key, item, ts) as they become known; a key's puts must come in the order of ts.

    The state of a key is bounded by the capacity. Items expire when the watermark has passed them, also without a
    further put. Needs a state store with several column families (RocksDB) and the time zone UTC.
    """
    rows = puts.select(named(F.col("key")).alias("key"), "item", "ts").withWatermark("ts", late).groupBy("key")
    out = rows.transformWithStateInPandas(statefulProcessor=Buffer(ttl, capacity), outputStructType=ENDS.replace("key long", "key string"), outputMode="Append", timeMode="EventTime")
    return out.withColumn("key", unnamed(F.col("key"), "long"))
