"""Operator 2: contiguous shards of near-equal bytes from global prefix sums.

Documents stand in one global order, by a hash of the text and then of the id, so equal texts are neighbours. The
order is cut into cells, by the leading bits of the hash; a text with very many copies has cells of its own, by its
ids' hash. Cell totals are prefix-summed (a few thousand rows, whatever the input), and a window inside each cell
gives every document its place in the whole. Equal targets cut the order. A group of equal texts that is small
against a shard goes whole to the shard that holds its middle; a larger one is cut like the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stored


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16, whole_group: float = 0.02, cell_bits: int = 10) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    size is the text's UTF-8 bytes plus overhead; a null text has no bytes and a null checksum, and nulls form one
    group. slot counts from 0 in each shard. An empty table gives no rows. Repeated rows are rows of their own.
    """
    cells = 1 << cell_bits
    base = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("h"))
    base = stored(base.withColumn("o", F.xxhash64(F.lit(11), "doc_id")), "sized")
    total_rows, total_bytes = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    most = max(1, total_rows // cells)
    groups = base.groupBy("h", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    # at most `cells` groups can hold more than a cell's share of the rows
    hot = F.broadcast(groups.where((F.col("copies") > max(most, 32))).select(F.col("h").alias("_h"), F.col("text_crc32").alias("_crc"), F.ceil(F.col("copies") / max(most, 32)).alias("parts")).limit(cells))
    placed = base.join(hot, (F.col("h") == F.col("_h")) & F.col("text_crc32").eqNullSafe(F.col("_crc")), "left")
    placed = placed.select(
        "doc_id", "size", "text_crc32", "h", "o",
        F.shiftrightunsigned(F.col("h"), 64 - cell_bits).alias("c0"),
        F.col("parts").isNotNull().alias("c1"),
        F.when(F.col("parts").isNotNull(), F.col("h")).alias("c2"),
        F.when(F.col("parts").isNotNull(), F.col("text_crc32")).alias("c3"),
        F.when(F.col("parts").isNotNull(), F.pmod("o", "parts")).alias("c4"),
    )
    cell = ["c0", "c1", "c2", "c3", "c4"]
    before = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*cell).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    totals = totals.select(*(F.col(c).alias(f"_{c}") for c in cell), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    # at most three times `cells` rows, whatever the input
    same = F.lit(True)
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = placed.join(F.broadcast(totals), same, "inner")
    inside = Window.partitionBy(*cell).orderBy("h", "text_crc32", "o", "doc_id", "size")
    group = Window.partitionBy(*cell, "h", "text_crc32")
    placed = placed.withColumn("end", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1)
    placed = placed.withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_end", F.max("end").over(group))
    whole = ~F.col("c1") & (F.col("group_bytes") <= whole_group * total_bytes / shards)
    middle = F.when(whole, F.col("group_end") * 2 - F.col("group_bytes")).otherwise(F.col("end") * 2 - F.col("size"))
    sharded = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * max(total_bytes, 1)))).cast("int"))
    sharded = stored(sharded.select("doc_id", "size", "text_crc32", "shard", "place"), "sharded")
    first = sharded.groupBy("shard").agg(F.min("place").alias("first"))  # one row for each shard
    return sharded.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes; see shard_by_bytes()."""
    return shard_by_bytes(documents(spark, sf_dir))
