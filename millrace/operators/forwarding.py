"""Whether what a user asked for reached the tool: expectations of each turn against the arguments of its calls, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKS = ["turn_id", "field", "expected", "status"]


def _folded(values: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(values, lambda x: x.isNotNull()), F.lower))


def forwarded(expected: DataFrame, calls: DataFrame) -> DataFrame:
    """(turn_id, field, expected, status) of every expectation: passed, failed or not_machine_checkable.

    expected: turn_id, field, value and accepted, the values any of which will do (null: nothing can tell, an empty
    array accepts nothing). calls: turn_id, field, values: one row for each argument of a call. Values are compared in
    lower case against the union of all calls of the turn; a turn without calls fails what can be checked. Repeated
    expectations are checks of their own; a null turn_id is one turn; calls without expectation tell nothing.
    """
    union = calls.select("turn_id", "field", F.explode(_folded(F.col("values"))).alias("_v")).distinct()
    rows = expected.select("turn_id", "field", F.col("value").alias("expected"), _folded(F.col("accepted")).alias("_accepted")).withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    asked = rows.select("_row", F.col("turn_id").alias("_turn"), F.col("field").alias("_field"), F.explode("_accepted").alias("_a"))
    same = F.col("_turn").eqNullSafe(F.col("turn_id")) & (F.col("_field") == F.col("field")) & (F.col("_a") == F.col("_v"))
    hit = asked.join(union, same).select("_row").distinct().withColumn("_hit", F.lit(True))
    status = F.when(F.col("_accepted").isNull(), "not_machine_checkable").when(F.col("_hit"), "passed").otherwise("failed")
    return rows.join(hit, "_row", "left").select("turn_id", "field", "expected", status.alias("status"))


def turn_status(turns: DataFrame, checks: DataFrame, calls: DataFrame) -> DataFrame:
    """(turn_id, checks, calls, status) of every turn: not_applicable (neither), no_call, failed or passed."""
    of = checks.groupBy(F.col("turn_id").alias("_t")).agg(F.count(F.lit(1)).alias("checks"), F.bool_or(F.col("status") == "failed").alias("_failed"))
    made = calls.groupBy(F.col("turn_id").alias("_u")).agg(F.count_distinct("call").alias("calls"))
    at = turns.select("turn_id").join(of, F.col("turn_id").eqNullSafe(F.col("_t")), "left").join(made, F.col("turn_id").eqNullSafe(F.col("_u")), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.when((n("checks") == 0) & (n("calls") == 0), "not_applicable").when((n("checks") > 0) & (n("calls") == 0), "no_call").when(F.col("_failed"), "failed").otherwise("passed")
    return at.select("turn_id", n("checks").alias("checks"), n("calls").alias("calls"), status.alias("status"))


def forwarding_rate(checks: DataFrame) -> DataFrame:
    """One row: machine_checks, passed, failed and the rate of those passed (null without any), by field expectations alone."""
    passed, failed = F.count_if(F.col("status") == "passed"), F.count_if(F.col("status") == "failed")
    return checks.agg(passed.alias("passed"), failed.alias("failed")).select(
        (F.col("passed") + F.col("failed")).alias("machine_checks"), "passed", "failed", F.when(F.col("passed") + F.col("failed") > 0, F.round(F.col("passed") / (F.col("passed") + F.col("failed")), 4)).alias("rate")
    )


def hard_constraints(turns: DataFrame, checks: DataFrame) -> DataFrame:
    """(turn_id, score, critical, violations): the mean of a turn's checks that could be made, and the names of those that failed.

    checks: turn_id, name, passed (null: not made). A turn without any scores 1; violations stand in the order of their
    names, each once.
    """
    made = checks.where("passed is not null").groupBy(F.col("turn_id").alias("_t")).agg(
        F.round(F.avg(F.col("passed").cast("int")), 4).alias("_score"), F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("name")))).alias("_bad")
    )
    at = turns.select("turn_id").join(made, F.col("turn_id").eqNullSafe(F.col("_t")), "left")
    bad = F.coalesce("_bad", F.array().cast("array<string>"))
    return at.select("turn_id", F.coalesce("_score", F.lit(1.0)).alias("score"), (F.size(bad) > 0).alias("critical"), bad.alias("violations"))
