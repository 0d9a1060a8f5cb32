"""Joins whose tables a plan takes for small, and pairs that meet only where they may match."""

from millrace.operators import names, similarity
from millrace.plans import relational


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_names_and_sets_are_not_broadcast(spark):
    table = spark.createDataFrame([("abcdefgh",), ("abcdefgi",), ("zzzz",)], "name string")
    found = names.name_pairs(table, 0.78, "edit")
    assert "Broadcast" not in plan_of(found) and [(r["a"], r["b"]) for r in found.collect()] == [("abcdefgh", "abcdefgi")]
    sets = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "c", "d"]), (3, ["x"])], "id long, elements array<string>")
    pairs = similarity.set_pairs(sets, [], 0.7)
    # the tables that hold whole sets or a row for each element
    plan = plan_of(pairs)
    assert plan.count("SortMergeJoin") >= 5 and [tuple(r) for r in pairs.collect()] == [(1, 2, 0.75)]


def test_balances_meet_in_bins(spark, tmp_path):
    rows = [(i, i % 2, "A", b) for i, b in enumerate([-21.0, -1.0, -0.5, 0.0, 18.99, 19.99, 20.0, 39.99, 41.99, 42.0, 60.5, 62.0, 5e9, None])]
    rows += [(100 + i, None, "A", 1.0) for i in range(3)] + [(200 + i, 1, "B", i * 6.5) for i in range(20)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    found = relational.self_join_inequality(spark, str(tmp_path))
    expected = {(a[0], b[0]) for a in rows for b in rows if a[1] is not None and a[1:3] == b[1:3] and a[0] < b[0] and None not in (a[3], b[3]) and abs(a[3] - b[3]) < 20}
    assert sorted(map(tuple, found.collect())) == sorted(expected) and len(expected) > 40
    # rows of one nation and segment are joined by bin
    assert "_bin" in plan_of(found).split("Join", 1)[1].split("\n")[0]
