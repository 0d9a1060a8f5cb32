"""Operator 1: mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The budget (a share of all words) is split over the sources by weight, no target above a multiple of its source's
words; what a capped source leaves is reshared by weight. The budget is then a number of equal blocks. Blocks go to
sources, and within a source to its shards, by highest quotients votes / (2 k - 1). In a shard the documents stand
in a seeded order, once for each allowed pass, and are cut into blocks. As that order is drawn by the seed, its first
blocks are a seeded choice of the shard's blocks; the quota says how many of them are taken.
All counts come from prefix sums in closed form, so no block is ever a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_names, small, stored

WORD = r"[^\x20\x09-\x0D]+"


def seats(votes: DataFrame, by: list[str], vote: str, house: str, parties: str) -> DataFrame:
    """Sainte-Lague: ``house`` seats of each group ``by`` over its rows by ``vote``; ties by the row's ``tie`` column.

    round(vote / d) is itself an allocation by highest quotients, for a house near the wanted one; the few seats
    that lack (or are too many) are then given (or taken) by the quotients that stand next, so few quotients are rows.
    parties: the column with the group's number of rows. Rows without votes get none.
    """
    group = Window.partitionBy(*by)
    at = votes.withColumn("_all", F.sum(vote).over(group))
    share = F.when(F.col("_all") > 0, F.col(vote) / F.col("_all")).otherwise(0.0)
    at = at.withColumn("_base", F.floor(share * F.col(house) + 0.5).cast("long"))
    at = at.withColumn("_lack", F.col(house) - F.sum("_base").over(group))
    reach = (F.ceil(share * F.col(parties) / 2) + 2).cast("long")
    step = F.when(F.col("_lack") > 0, F.sequence(F.lit(1).cast("long"), reach)).when(
        F.col("_lack") < 0, F.sequence(F.lit(0).cast("long"), -F.least(reach, F.col("_base")))
    )
    near = (
        at.where((F.col(vote) > 0) & (F.col("_lack") != 0))
        .select(*by, "tie", vote, "_base", "_lack", F.explode(step).alias("_k"))
        .withColumn("_seat", F.col("_base") + F.col("_k"))
        .where(F.col("_seat") >= 1)
        .withColumn("_q", F.col(vote) / (2 * F.col("_seat") - 1))
        .withColumn("_up", F.col("_lack") > 0)
    )
    order = Window.partitionBy(*by).orderBy(F.when(F.col("_up"), -F.col("_q")).otherwise(F.col("_q")), F.when(F.col("_up"), F.col("tie")), F.desc("tie"), F.abs("_k"))
    moved = (
        near.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= F.abs("_lack"))
        .groupBy(*by, "tie")
        .agg(F.sum(F.when(F.col("_up"), 1).otherwise(-1)).alias("_moved"))
    )
    keys = [*by, "tie"]
    moved = moved.select(*(F.col(k).alias(f"_m_{k}") for k in keys), "_moved")
    same: Column = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
    out = at.join(moved, same, "left").withColumn("quota", F.col("_base") + F.coalesce("_moved", F.lit(0)))
    return out.drop("_all", "_base", "_lack", "_moved", *(f"_m_{k}" for k in keys))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, passes: int) -> tuple[DataFrame, int]:
    """(source, source_size, docs, target, n_sources) for each source, and the number of sources.

    Sources by code point, null last, take the weights in turn. With sources in order of cap / weight, those that reach
    their cap are the first so many; prefix sums give for each number of them the rate that is left for the others,
    and the first that holds is the answer: later ones hold too but are lower, so one maximum finds it for any number of sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    # Spark compares strings by their UTF-8 bytes, which is the order of code points
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    totals = totals.withColumn("weight", F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")))
    totals = stored(totals.withColumn("cap", (F.col("source_size") * passes).cast("double")), "sources")
    n, words, weight = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    rate, budget = 0.0, share * words
    if words:
        order = Window.orderBy("_full", "_name")
        full = totals.select("weight", "cap", (F.col("cap") / F.col("weight")).alias("_full"), F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("_name"))
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        full = full.withColumn("_caps", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("_weights", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        full = full.withColumn("_rate", (F.lit(budget) - F.col("_caps")) / (F.lit(float(weight)) - F.col("_weights")))
        rate, most = full.agg(F.max(F.when(F.col("_rate") < F.col("_full"), F.col("_rate"))), F.max("_full")).first()
        rate = most if rate is None else rate
    return totals.withColumn("target", F.least("cap", F.col("weight") * F.lit(float(rate)))).withColumn("n_sources", F.lit(n)), n


def placed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, passes: int = 2, block: int = 16, seed: int = 7, rows_per_shard: int = 50_000) -> DataFrame:
    """The rows of mix() with _h, the hash of their text."""
    ours = ["size", "source_size", "target", "taken"]
    sizes = docs.select("doc_id", "source", F.xxhash64("text").alias("_h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = stored(sizes, "sizes")
    targets, n_sources = source_targets(sizes, weights, share, passes)
    targets = stored(
        seats(targets.withColumn("tie", F.col("source")).withColumn("_g", F.lit(0)).withColumn("_house", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long")), ["_g"], "target", "_house", "n_sources")
        .select("source", "source_size", "docs", "target", F.col("quota").alias("source_quota")),
        "targets",
    )
    # shards: as many for each source as its documents ask for, so a hot source is spread over many
    total = sizes.count()
    per_shard = max(64, min(rows_per_shard, total // 4096))
    dealt = sizes.join(small(targets, n_sources), sizes["source"].eqNullSafe(targets["source"]), "inner").drop(targets["source"])
    # a null takes no part in a hash: rows without an id are dealt by their text, all others by their id alone
    own = F.when(F.col("doc_id").isNull(), F.col("_h"))
    key = F.xxhash64(F.lit(seed), "doc_id", own)
    dealt = dealt.withColumn("shard", F.pmod(key, F.ceil(F.col("docs") / per_shard))).withColumn("_order", F.xxhash64(F.lit(seed + 1), "doc_id", own))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = shards.withColumn("n_shards", F.count(F.lit(1)).over(Window.partitionBy("source"))).withColumn("tie", F.col("shard"))
    shards = stored(seats(shards, ["source"], "shard_size", "source_quota", "n_shards").select("source", "shard", "shard_size", "quota"), "quotas")
    # the shard's sequence: `passes` times its documents, cut into equal blocks of about `block` words; its quota of
    # blocks is taken from the start of the seeded order, so that documents are taken whole but for one of a shard
    length = F.col("shard_size") * passes
    blocks = F.greatest(F.lit(1), F.round(length / block).cast("long"))
    shards = shards.withColumn("limit", F.round(F.least("quota", blocks) * length / blocks).cast("long"))
    inside = Window.partitionBy("source", "shard").orderBy("_order", "doc_id", "size", "_h").rowsBetween(Window.unboundedPreceding, 0)
    at = dealt.withColumn("_end", F.sum("size").over(inside)).withColumnRenamed("source", "_source").withColumnRenamed("shard", "_shard")
    at = at.join(shards, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_shard") == F.col("shard")), "inner")
    taken, copies = F.lit(0).cast("long"), F.lit(0)
    for p in range(passes):
        room = F.col("limit") - p * F.col("shard_size") - (F.col("_end") - F.col("size"))
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), room))
        copies = copies + (room * 2 > F.col("size")).cast("int")
    at = at.withColumn("taken", taken).withColumn("copies", copies)
    return at.select("doc_id", "source", "_h", *ours, "copies", "shard", F.col("quota").alias("shard_quota"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """docs with size, source_size, target and taken (words of the document that the mix takes, repeats counted).

    Null text has size 0; a null source is a source of its own; an empty table gives an empty result; repeated rows
    each count; columns of docs with one of our names give way to ours. Settings: see placed().
    """
    return placed(docs, **settings).drop("_h")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; a document that is taken in part counts by its half.

    All columns stay, whatever their names. Rows of equal doc_id, source and text share what the mix takes of them as
    evenly as can be. Null texts and texts without words have size 0 and are taken in every pass that reaches their
    place; a null source is a source of its own; an empty table gives an empty result.
    """
    own = own_names(docs.columns, "_id", "_source", "_h", "_copies", "_rows", "_each", "_over", "_nth")
    ident, source, h, copies, rows, each, over, nth = own
    taken = placed(docs.select("doc_id", "source", "text"), **settings).groupBy("doc_id", "source", "_h")
    taken = taken.agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0")
    taken = stored(taken, "copies").toDF(*own[:5])
    same = F.col("doc_id").eqNullSafe(F.col(ident)) & F.col("source").eqNullSafe(F.col(source)) & (F.xxhash64("text") == F.col(h))
    kept = docs.join(taken, same).withColumn(each, F.floor(F.col(copies) / F.col(rows)).cast("int")).withColumn(over, F.col(copies) % F.col(rows))
    # equal rows stand together in their shard's sequence, so few groups are cut by a quota and have rows to number
    if taken.where(F.col(copies) % F.col(rows) > 0).limit(1).count():
        place = F.row_number().over(Window.partitionBy(ident, source, h).orderBy(over))
        uneven = kept.where(F.col(over) > 0).withColumn(nth, place).withColumn(each, F.col(each) + (F.col(nth) <= F.col(over)).cast("int")).drop(nth)
        kept = kept.where(F.col(over) == 0).unionByName(uneven)
    return kept.where(F.col(each) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(each)))).select(*docs.columns)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed; see mix()."""
    from .common import documents

    return mix(documents(spark, sf_dir))
