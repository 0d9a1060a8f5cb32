"""Forwarding of constraints with orders as turns and every other line as a call; the SQL checks each expectation by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forwarding
from ..session import checkpoints, table


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns, expectations and calls: orders ask for parts by name and for flags; lines with an odd number are calls."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    made = lines.where("l_linenumber % 2 = 1").withColumn("call", F.expr("concat(l_linenumber, ':', l_partkey, ':', l_suppkey)"))
    args = [("excluded", F.array(F.upper("p_name"))), ("diets", F.array("l_returnflag", "l_linestatus")), ("time", F.array(F.col("p_size").cast("string")))]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("values")) for k, v in args))).alias("a")
    calls = made.select(F.col("l_orderkey").alias("turn_id"), "call", each).select("turn_id", "call", "a.field", "a.values")
    asked = lines.where("l_linenumber <= 2 and l_partkey % 3 <> 0").select(F.col("l_orderkey").alias("turn_id"), F.lit("excluded").alias("field"), F.col("p_name").alias("value"), F.when(F.col("l_suppkey") % 10 != 0, F.array("p_name")).alias("accepted"))
    flags = orders.where("o_custkey % 4 = 0").select(F.col("o_orderkey").alias("turn_id"), F.lit("diets").alias("field"), F.lit("ar").alias("value"), F.array(F.lit("a"), F.lit("R")).alias("accepted"))
    return orders.select(F.col("o_orderkey").alias("turn_id")), asked.unionByName(flags), calls


def forwarding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations by field and status, turns by status, and the rate, as rows of one report."""
    checkpoints(spark)
    turns, expected, calls = _inputs(spark, sf_dir)
    checks = forwarding.forwarded(expected, calls).checkpoint()
    by_field = checks.groupBy(F.concat_ws(":", "field", "status").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    by_turn = forwarding.turn_status(turns, checks, calls).groupBy(F.concat(F.lit("turn:"), "status").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return by_field.unionByName(by_turn).unionByName(forwarding.forwarding_rate(checks).select(F.lit("rate").alias("key"), F.col("rate").alias("value")))


def hard_constraint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's score over its checks, and what it failed."""
    checkpoints(spark)
    turns, expected, calls = _inputs(spark, sf_dir)
    checks = forwarding.forwarded(expected, calls)
    named = checks.select("turn_id", F.concat_ws(":", F.lit("tool_omitted"), "field", "expected").alias("name"), F.when(F.col("status") != "not_machine_checkable", F.col("status") == "passed").alias("passed"))
    return forwarding.hard_constraints(turns, named).withColumn("violations", F.array_join("violations", ","))


_CHECKS = """
    WITH l AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT * FROM l WHERE l_linenumber % 2 = 1),
    checks AS (
      SELECT l_orderkey AS turn_id, 'excluded' AS field, p_name AS expected, CASE WHEN l_suppkey % 10 = 0 THEN 'not_machine_checkable'
        WHEN EXISTS (SELECT 1 FROM c WHERE c.l_orderkey = l.l_orderkey AND c.p_name = l.p_name) THEN 'passed' ELSE 'failed' END AS status FROM l WHERE l_linenumber <= 2 AND l_partkey % 3 <> 0
      UNION ALL
      SELECT o_orderkey, 'diets', 'ar', CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.l_orderkey = o_orderkey AND l_returnflag IN ('A', 'R')) THEN 'passed' ELSE 'failed' END FROM orders WHERE o_custkey % 4 = 0
    )"""
QUERIES = {"forwarding_audit": forwarding_audit, "hard_constraint_scores": hard_constraint_scores}
ORACLES = {
    "forwarding_audit": _CHECKS
    + """, turns AS (
      SELECT o_orderkey, (SELECT count(*) FROM checks WHERE turn_id = o_orderkey) AS n, (SELECT count(*) FROM checks WHERE turn_id = o_orderkey AND status = 'failed') AS bad, (SELECT count(*) FROM c WHERE l_orderkey = o_orderkey) AS made FROM orders
    )
    SELECT field || ':' || status AS key, count(*)::DOUBLE AS value FROM checks GROUP BY 1
    UNION ALL SELECT 'turn:' || CASE WHEN n = 0 AND made = 0 THEN 'not_applicable' WHEN made = 0 THEN 'no_call' WHEN bad > 0 THEN 'failed' ELSE 'passed' END, count(*)::DOUBLE FROM turns GROUP BY 1
    UNION ALL SELECT 'rate', round(count(*) FILTER (status = 'passed') / count(*) FILTER (status <> 'not_machine_checkable')::DOUBLE, 4) FROM checks""",
    "hard_constraint_scores": _CHECKS
    + """ SELECT o_orderkey AS turn_id, coalesce(round(avg((status = 'passed')::INT) FILTER (status <> 'not_machine_checkable'), 4), 1.0::DOUBLE) AS score,
      count(*) FILTER (status = 'failed') > 0 AS critical, coalesce(string_agg(DISTINCT 'tool_omitted:' || field || ':' || expected, ',' ORDER BY 'tool_omitted:' || field || ':' || expected) FILTER (status = 'failed'), '') AS violations
    FROM orders LEFT JOIN checks ON turn_id = o_orderkey GROUP BY o_orderkey""",
}
