"""Small fixtures: text rules, set joins, clusters, fusion, streams."""

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import similarity, vectors
from millrace.streaming import states


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_text_rules(spark):
    assert one(spark, "  Red_Onion - big ", tx.lookup_key) == "redonionbig"
    assert one(spark, "番茄 Ä-1!", tx.compact) == "番茄ä1"
    assert one(spark, "ab", tx.char_ngrams) == ["ab"]
    assert one(spark, "", tx.char_ngrams) == []
    assert one(spark, "ab", lambda c: tx.char_ngrams(c, 3, False)) == []
    assert sorted(one(spark, "abcd", tx.char_ngrams)) == ["abc", "bcd"]
    assert one(spark, "x" * 80, tx.title) == "x" * 59 + "…"
    unsafe = lambda c: tx.unsafe_clause(c, "peanut", "no|without")
    assert one(spark, "Add peanut. No sugar.", unsafe) and not one(spark, "Without peanut. Fine.", unsafe)


def test_set_pairs_against_all_pairs(spark):
    rows = [(i, i % 2, [f"t{j}" for j in range(i % 7, i % 7 + 5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, block int, elements array<string>")
    found = {(r[0], r[1]) for r in similarity.set_pairs(df, ["block"], 0.6).collect()}
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and len(set(a[2]) & set(b[2])) / len(set(a[2]) | set(b[2])) >= 0.6}
    assert found == expected


def test_clusters_of_a_chain(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    links = spark.createDataFrame([(i, i + 1) for i in range(10)] + [(20, 21)], "a long, b long")
    assert {r["node"]: r["root"] for r in similarity.clusters(links, "a", "b").collect()} == {**dict.fromkeys(range(11), 0), 20: 20, 21: 20}


def test_fusion_prefers_items_of_both_lanes(spark):
    lane = lambda *items: spark.createDataFrame([(1, i, r + 1) for r, i in enumerate(items)], "query_id long, item_id long, rank int")
    best = vectors.fuse([(lane(5, 7), 1.0), (lane(9, 7), 1.0)]).orderBy(F.desc("score")).first()
    assert best["item_id"] == 7


def test_stream_stops_at_the_terminal_event(spark, tmp_path):
    rows = [(1, 1, "click"), (2, 1, "purchase"), (3, 1, "click"), (4, 2, "view")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, event_type string").parquet(str(tmp_path / "in"))
    query = states.until_terminal(stream).writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("select * from folded").collect()} == {(1, 2, 1), (2, 1, 0)}
