"""Connected components of links, by rounds of joins and minima; nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Members of a group in a block of those that are all compared.
BLOCK = 256


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of links: root is the least node of its component.

    Each round, every node that has larger neighbours links them, and itself, to its least neighbour (large star),
    then every node links its smaller neighbours to the least of them (small star); the rounds end when a round
    changes nothing. A node's neighbours meet only as a minimum and as rows, never as a list. The number of rounds
    grows with the logarithm of the longest path.
    """
    edges = stored(links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lows.select("u", F.col("m").alias("v")))
        new = stored(small.distinct(), "small")
        (old_n, old_sum), (new_n, new_sum) = (e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for e in (edges, new))
        discard(edges, large)
        edges = new
        if (old_n, old_sum) == (new_n, new_sum):
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def crossing(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members (g, h and more) with their component's root, of the groups g that hold more than one component."""
    at = members.join(roots, F.col("h") == F.col("node"), "left").select(*members.columns, F.coalesce("root", "h").alias("root"))
    several = at.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("g")
    return at.join(several, "g", "left_semi")


def headed(members: DataFrame, *more: str, order: Column | None = None) -> DataFrame:
    """members (g, h, root and more) each beside two of its group, of the first and the last root: r, where its root is another.

    order: a number for each root, by which they stand; by default the root itself.
    """
    chosen = F.struct((F.col("root") if order is None else order).alias("at"), "root", "h", *more)
    heads = members.groupBy("g").agg(F.array(F.min(chosen), F.max(chosen)).alias("rs"))
    return members.join(heads, "g").select("h", "root", *more, F.explode("rs").alias("r")).where(F.col("root") != F.col("r.root"))


def between(members: DataFrame, *more: str, also: Column | None = None) -> DataFrame:
    """All pairs of members (g, h, root and more) of one group and unlike roots, the other one as r; large groups in pairs of blocks."""
    sizes = members.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("h"), "blocks").cast("int"))
    left = dealt.select("g", "h", "root", *more, F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = dealt.select("g", F.struct("h", "root", *more).alias("r"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i"))
    met = left.join(right, ["g", "i", "j"]).where((F.col("root") != F.col("r.root")) & ((F.col("i") < F.col("j")) | (F.col("h") < F.col("r.h"))))
    return met if also is None else met.where(also)
