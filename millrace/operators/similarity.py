"""Similarity joins over sets by an inverted index, clusters of links, ordered duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def set_pairs(sets: DataFrame, block: list[str], threshold: float, item: str = "id", elements: str = "elements") -> DataFrame:
    """(left_id, right_id, similarity): pairs of one block with Jaccard >= threshold, left_id < right_id.

    Elements are ordered rarest first inside the block; two sets that reach the threshold share one of their first
    size - ceil(threshold size) + 1 elements, so only those are joined, and only sets of fitting sizes. Equal sets
    are joined as one and their items put in at the end, as the result lists every pair.
    """
    # an empty set is alike to empty sets alone: it gets one element that no other set has
    empty = F.array(F.lit("\0empty"))
    known = F.coalesce(F.array_sort(F.array_distinct(F.col(elements).cast("array<string>"))), F.array().cast("array<string>"))
    sets = sets.select(F.col(item).alias("_item"), *block, F.when(F.size(known) == 0, empty).otherwise(known).alias("_set"))
    # sets that many items have meet once, as one representative
    distinct = sets.groupBy(*block, "_set").agg(F.min("_item").alias("_id"))
    rows = distinct.select("_id", *block, F.explode("_set").alias("_e"))
    often = rows.groupBy(*block, "_e").agg(F.count(F.lit(1)).alias("_f"))
    ordered = rows.join(often.hint("merge"), [*block, "_e"])
    group = Window.partitionBy(*block, "_id")
    first = ordered.withColumn("_p", F.row_number().over(group.orderBy("_f", "_e"))).withColumn("_n", F.count(F.lit(1)).over(group))
    first = first.where(F.col("_p") <= F.col("_n") - F.ceil(F.lit(threshold) * F.col("_n") - 1e-9) + 1)
    left, right = (first.select(*block, "_e", F.col("_id").alias(f"_{s}"), F.col("_n").alias(f"_n_{s}"), F.col("_p").alias(f"_p_{s}")) for s in ("left", "right"))
    # what both may still share behind the place where they meet must be enough for the overlap
    overlap = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("_n_left") + F.col("_n_right")) - 1e-9)
    rest = F.least(F.col("_n_left") - F.col("_p_left"), F.col("_n_right") - F.col("_p_right")) + F.least("_p_left", "_p_right")
    fits = (F.least("_n_left", "_n_right") >= threshold * F.greatest("_n_left", "_n_right") - 1e-9) & (rest >= overlap)
    met = left.join(right.hint("merge"), [*block, "_e"]).where((F.col("_left") < F.col("_right")) & fits).select(*block, "_left", "_right").distinct()
    # sets and their elements are as many as the input's, whatever a plan takes them for: they are never sent to all tasks
    a, b = (distinct.hint("merge").select(*block, F.col("_id").alias(f"_{s}"), F.col("_set").alias(f"_set_{s}")) for s in ("left", "right"))
    shared, either = F.size(F.array_intersect("_set_left", "_set_right")), F.size(F.array_union("_set_left", "_set_right"))
    alike = met.join(a, [*block, "_left"]).join(b, [*block, "_right"]).select(*block, "_left", "_right", F.round(shared / either, 6).alias("similarity"))
    alike = alike.where(F.col("similarity") >= threshold).unionByName(distinct.select(*block, F.col("_id").alias("_left"), F.col("_id").alias("_right"), F.lit(1.0).alias("similarity")))
    named = sets.join(distinct.hint("merge"), [*block, "_set"]).select(*block, "_id", "_item")
    x, y = (named.select(*block, F.col("_id").alias(f"_{s}"), F.col("_item").alias(f"_x_{s}")) for s in ("left", "right"))
    out = alike.join(x, [*block, "_left"]).join(y, [*block, "_right"])
    # between unlike sets each item pair comes once; inside one set both ways, of which one stays
    out = out.where((F.col("_left") != F.col("_right")) | (F.col("_x_left") < F.col("_x_right")))
    return out.select(F.least("_x_left", "_x_right").alias("left_id"), F.greatest("_x_left", "_x_right").alias("right_id"), "similarity")


def clusters(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): least node of each connected component, by label propagation until no label changes."""
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b"))
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root").checkpoint()
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("low"))
        # a node takes the least label around it, then that label's own label
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "low").alias("root"))
        jump = step.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = step.join(jump, F.col("root") == F.col("_n")).select("node", F.least("root", "_r").alias("root")).checkpoint()
        changed = new.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def first_accepted(records: DataFrame, links: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(ordinal, duplicate_of) of each record (ordinal, name): the first earlier accepted record that it repeats, or null.

    Records are taken in order; one that has the name of an accepted one, or a link (left_id < right_id, by ordinals)
    to one, is rejected, all others are accepted. baseline: (ordinal, name) of records accepted beforehand, whose
    ordinals come before all others. Each round decides every record whose earlier neighbours are all decided, by
    joins and minima; records of one name meet only as the least ordinals of their name. Rounds: as many as the
    longest chain of open neighbours.
    """
    before = records.limit(0).select("ordinal", "name") if baseline is None else baseline.select("ordinal", "name")
    state = before.withColumn("accepted", F.lit(True)).unionByName(records.select("ordinal", "name").withColumn("accepted", F.lit(None).cast("boolean")))
    state = state.withColumn("duplicate_of", F.lit(None).cast("long")).checkpoint()
    edges = links.select(F.col("right_id").alias("later"), F.col("left_id").alias("ordinal")).distinct().checkpoint()
    while True:
        names = state.where("name is not null").groupBy(F.col("name").alias("_name")).agg(F.min(F.when(F.col("accepted"), F.col("ordinal"))).alias("name_accepted"), F.min(F.when(F.col("accepted").isNull(), F.col("ordinal"))).alias("name_open"))
        near = edges.join(state.select("ordinal", "accepted"), "ordinal").groupBy("later").agg(
            F.min(F.when(F.col("accepted"), F.col("ordinal"))).alias("link_accepted"), F.max(F.col("accepted").isNull()).alias("link_open")
        )
        at = state.join(names, F.col("name") == F.col("_name"), "left").join(near, F.col("ordinal") == F.col("later"), "left")
        earlier = F.least("name_accepted", "link_accepted")
        # once a name's least accepted record comes before its open ones, none of these can be accepted
        name_waits = (F.col("name_open") < F.col("ordinal")) & (F.col("name_accepted").isNull() | (F.col("name_open") < F.col("name_accepted")))
        waits = F.coalesce(name_waits, F.lit(False)) | F.coalesce("link_open", F.lit(False))
        undecided = F.col("accepted").isNull()
        repeats = undecided & (earlier < F.col("ordinal"))
        new = at.select(
            "ordinal", "name",
            F.when(F.coalesce(repeats & ~waits, F.lit(False)), False).when(undecided & ~waits, True).otherwise(F.col("accepted")).alias("accepted"),
            F.when(F.coalesce(repeats & ~waits, F.lit(False)), earlier).otherwise(F.col("duplicate_of")).alias("duplicate_of"),
        ).checkpoint()
        state = new
        if not state.where("accepted is null").limit(1).count():
            return state.join(records.select("ordinal"), "ordinal", "left_semi").select("ordinal", "duplicate_of")


def reviewed(pairs: DataFrame) -> DataFrame:
    """pairs (left_id, right_id, same_name, name, ingredients, methods) with a decision: REJECT_RIGHT or HUMAN_REVIEW; others go.

    name, ingredients and methods are similarities from 0 to 1. Pairs alike in neither name nor ingredients go first.
    """
    name, parts, methods = F.col("name"), F.col("ingredients"), F.col("methods")
    decision = (
        F.when(F.col("same_name"), "REJECT_RIGHT")
        .when((parts >= 0.8) & (methods >= 0.99) & (name >= 0.55), "REJECT_RIGHT")
        .when(((parts >= 0.65) & (methods >= 0.99)) | (name >= 0.78), "HUMAN_REVIEW")
    )
    return pairs.where((name >= 0.45) | (parts >= 0.5)).withColumn("decision", decision).where("decision is not null")


def rejected_ids(reviews: DataFrame) -> DataFrame:
    """(id): the right side of every pair that is rejected."""
    return reviews.where("decision = 'REJECT_RIGHT'").select(F.col("right_id").alias("id")).distinct()
