"""Work that goes on where it stopped: what of each conversation is done, and whether what was done still holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import versions


class OtherRun(ValueError):
    """The progress on record belongs to a run with other metadata."""


def _digests(turns: DataFrame) -> DataFrame:
    """(conv_id, _turns): each conversation's (turn, digest of the turn) in order."""
    digest = F.sha2(F.concat_ws("\x1f", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", digest.alias("digest")))).alias("_turns"))


def _prefix(turns: Column, count: Column) -> Column:
    """Digest of the first so many turns, their places included."""
    first = F.slice(turns, F.lit(1), count)
    return F.sha2(F.array_join(F.transform(first, lambda t: F.concat_ws(":", t["turn"].cast("string"), t["digest"])), ","), 256)


def advanced(turns: DataFrame) -> DataFrame:
    """(conv_id, done, digest): the progress once all of turns (conv_id, turn, role, text) are done."""
    return _digests(turns).select("conv_id", F.size("_turns").alias("done"), _prefix(F.col("_turns"), F.size("_turns")).alias("digest"))


def pending(turns: DataFrame, progress: DataFrame) -> DataFrame:
    """The rows of turns that are to be done, with `restarted`: whether their conversation starts anew.

    A conversation goes on behind its first `done` turns if these are still what the digest was made of; if one of
    them was changed, moved or taken away, all its turns are to be done again. One without progress starts from its
    first turn. Digests stand in rows of their conversation; texts are read once for them and never gathered.
    Turns of one place are taken as they come by digest; null texts and roles are empty ones. Progress of
    conversations that are no longer there gives nothing.
    """
    state = progress.select(F.col("conv_id").alias("_conv"), "done", F.col("digest").alias("_then"))
    at = _digests(turns).join(state, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    holds = (F.col("done") <= F.size("_turns")) & (_prefix(F.col("_turns"), F.col("done")) == F.col("_then"))
    begun = F.col("done").isNotNull()
    at = at.select(F.col("conv_id").alias("_conv"), (begun & ~F.coalesce(holds, F.lit(False))).alias("restarted"), F.when(begun & F.coalesce(holds, F.lit(False)), F.element_at(F.slice("_turns", 1, F.col("done")), -1)["turn"]).alias("_last"))
    met = turns.join(at, turns["conv_id"].eqNullSafe(F.col("_conv")))
    return met.where(F.col("_last").isNull() | (F.col("turn") > F.col("_last"))).drop("_conv", "_last")


def resume(turns: DataFrame, root: str, work: Callable[[DataFrame], DataFrame], metadata: dict[str, str]) -> DataFrame:
    """The results of all turns, of which only pending ones go through work; progress and results are one versioned table.

    work takes rows of turns (with restarted) and gives rows with conv_id and turn. Progress is taken up only by a
    run with the same metadata, else OtherRun is raised and nothing is changed. Results and progress are swapped in
    together, so a run that fails on the way leaves those of the run before.
    """
    spark = turns.sparkSession
    last = versions.latest(spark, root)
    if last is None:
        done = work(turns.withColumn("restarted", F.lit(False)))
    else:
        if last["metadata"] != metadata:
            raise OtherRun(f"progress of {last['metadata']}, not of {metadata}")
        table = versions.read(spark, root)
        progress, results = table.where("result is null").select("progress.*"), table.where("result is not null").select("result.*")
        todo = pending(turns, progress)
        new = work(todo)
        # results hold for turns that are there and not done again; rows, so that a conversation's results never meet in one place
        stale = todo.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"))
        there = turns.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t")).distinct()
        same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t"))
        done = results.join(stale, same, "left_anti").join(there, same, "left_semi").unionByName(new)
    rows = done.select(F.struct(*done.columns).alias("result"))
    state = advanced(turns)
    both = rows.withColumn("progress", F.lit(None).cast(f"struct<{state.schema.simpleString()[7:-1]}>")).unionByName(
        state.select(F.lit(None).cast(rows.schema["result"].dataType).alias("result"), F.struct(*state.columns).alias("progress"))
    )
    versions.swap(both, root, metadata=metadata)
    return versions.read(spark, root).where("result is not null").select("result.*")
