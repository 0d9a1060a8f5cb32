"""Query sets from a corpus: kinds dealt in turn among the accepted, repeated texts skipped, then parted in two disjoint sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Sizes of the two sets.
DEVELOPMENT, HOLDOUT = 50, 75
SET = "query_id string, split string, number int, kind string, query string, item_id long"


def numbered(items: DataFrame, by: str) -> DataFrame:
    """items with `place` from 0 in the order of `by` (unique): ranges are numbered apart and start behind the counts before them."""
    width = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = items.repartitionByRange(width, by).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}  # one number a range
    before, starts = 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    first = F.broadcast(items.sparkSession.createDataFrame(starts, "_p int, _start long"))
    at = parts.join(first, F.col("_part") == F.col("_p"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return at.withColumn("place", F.col("_start") + inside - 1).drop("_part", "_p", "_start")


def strided(items: DataFrame, by: str) -> DataFrame:
    """items with `ordinal` from 0: every second one in the order of `by`, then the others, so that neighbours are spread."""
    at = numbered(items, by)
    half = F.lit((at.count() + 1) // 2)
    place = F.floor(F.col("place") / 2)
    return at.withColumn("ordinal", F.when(F.col("place") % 2 == 0, place).otherwise(half + place)).drop("place")


def query_sets(candidates: DataFrame, kinds: list[str], development: int = DEVELOPMENT, holdout: int = HOLDOUT) -> DataFrame:
    """(query_id, split, number, kind, query, item_id) of the two sets, numbered from 1 through both.

    candidates: ordinal (unique), item_id and texts, a text for each kind. They are taken in the order of ordinal; the
    n-th accepted one is of kind n modulo their number, and one whose text of that kind was accepted before (or is null) is
    skipped, so that the kind goes to the next. What is accepted depends on all before it, but only as many as are
    wanted are kept: candidates come to the driver in windows of a few times that, until the sets are full.
    ValueError if the corpus has too few different texts.
    """
    spark, wanted = candidates.sparkSession, development + holdout
    rows: list[tuple] = []
    seen: set[str] = set()
    known, start, width = candidates.select("ordinal", "item_id", "texts").checkpoint(), 0, 4 * wanted
    last = known.agg(F.max("ordinal")).first()[0]
    while len(rows) < wanted and last is not None and start <= last:
        for r in known.where((F.col("ordinal") >= start) & (F.col("ordinal") < start + width)).orderBy("ordinal").collect():
            n = len(rows)
            query = r["texts"][n % len(kinds)]
            if query is None or query in seen or n == wanted:
                continue
            seen.add(query)
            split = "development" if n < development else "holdout"
            rows.append((f"{split[:3]}-{n + 1:03d}", split, n + 1, kinds[n % len(kinds)], query, r["item_id"]))
        start += width
    if len(rows) < wanted:
        raise ValueError(f"only {len(rows)} of {wanted} different queries")
    return spark.createDataFrame(rows, SET)
