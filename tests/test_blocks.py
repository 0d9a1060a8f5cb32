"""Search by matrix products against scoring every pair with columns."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import blocks, vectors

SCHEMA = "vec_id long, embedding array<float>"


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("query_block", [20_000, 7])
def test_nearest_against_every_pair(spark, monkeypatch, query_block):
    monkeypatch.setattr(blocks, "QUERY_BLOCK", query_block)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(300)]  # many ties and vectors without length
    rows += [(400 + i, rows[0][1]) for i in range(20)] + [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [1.0] * 5), (503, []), (504, [float("nan")] * 6), (None, [1.0] * 6)]
    items = spark.createDataFrame(rows, SCHEMA).repartition(5)
    queries = items.where("vec_id % 10 = 0 or vec_id > 499").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = vectors.nearest(items, queries, 7)
    pairs = items.crossJoin(queries).where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("item_id"), F.round(vectors.cosine(F.col("embedding"), F.col("query_vector")), 6).alias("score"))
    expected = vectors.top_k(pairs, "query_id", "item_id", "score", 7)
    assert sorted(map(repr, found.select(*expected.columns).collect())) == sorted(map(repr, expected.collect()))
    # pairs are not rows of a join
    assert "Join" not in plan_of(found)


def test_weighted_parts_against_every_pair(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(30)]
    items = spark.createDataFrame(rows, SCHEMA)
    queries = items.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    half = lambda c, i: F.slice(c, 4 * i + 1, 4)
    s = [F.round(vectors.cosine(half("embedding", i), half("query_vector", i)), 6) for i in (0, 1)]
    pairs = items.crossJoin(queries).where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("item_id"), F.round(0.25 * s[0] + 0.75 * s[1], 5).alias("score"))
    expected = vectors.top_k(pairs, "query_id", "item_id", "score", 5).collect()
    assert sorted(map(repr, vectors.mixed_nearest(items, queries, 5, [(0, 4), (4, 8)], [0.25, 0.75], 5).collect())) == sorted(map(repr, expected))


def test_rounds_as_spark(spark):
    rng = random.Random(5)
    values = [i / 2e6 for i in range(-9, 10)] + [rng.uniform(-1, 1) for _ in range(50)] + [round(rng.uniform(-1, 1), 6) + 5e-7 for _ in range(50)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", F.round("x", 6).alias("y")).collect()
    assert list(blocks.rounded(__import__("numpy").array([r["x"] for r in rows]), 6)) == [r["y"] for r in rows]
