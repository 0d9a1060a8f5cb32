"""Hybrid retrieval and the forwarding audit against plain Python on small tables."""

import math
import random

from pyspark.sql import functions as F

from millrace.operators import forwarding, hybrid

ITEM = "item_id long, name string, parts array<string>, scenarios array<string>, terms array<string>, diets array<string>, minutes double, quality double, vector array<float>, dataset string, model string"
QUERY = "query_id long, text string, parts array<string>, scenarios array<string>, terms array<string>, dish_terms array<string>, diets array<string>, excluded array<string>, max_minutes double, limit double, preference double, vector array<float>"


def cosine(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / size if size else 0.0


def rule(i, q):
    share = lambda a, b: len(set(a) & set(b)) / len(b) if b else 0.0
    coverage = share(i["parts"], q["parts"])
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum() or c == "_")
    score = coverage * 8 + (3 if q["parts"] and coverage == 1 else 0) + (5 if plain(i["name"]) and plain(i["name"]) in plain(q["text"]) else 0)
    score += 2 * sum(t in i["name"].lower() for t in q["dish_terms"]) + 3 * len(set(i["scenarios"]) & set(q["scenarios"]))
    if q["max_minutes"] is not None:
        spare = q["max_minutes"] - i["minutes"]
        score += 3 + spare / 30 if spare >= 0 else -min(3.0, -spare / 10)
    return round(score + 3 * (q["preference"] or 0) + share(i["terms"], q["terms"]) + i["quality"] * 0.01, 6)


def test_retrieval_against_scoring_every_item(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(5)
    pick = lambda words, n: rng.sample(words, rng.randint(0, n))
    words = ["番茄", "鸡蛋", "tofu", "rice", "leek"]
    items = [dict(item_id=i, name=rng.choice(["番茄炒蛋", "Tofu bowl", "rice", "蛋饭"]), parts=pick(words, 3), scenarios=pick(["quick", "family"], 2), terms=pick(["番茄", "炒蛋", "bowl"], 2), diets=pick(["vegan", "nut_free"], 2), minutes=float(rng.randint(5, 90)), quality=rng.random() // 0.01, vector=[rng.choice([0.0, 1.0, -0.5, 0.25]) for _ in range(4)], dataset="v1", model="m") for i in range(150)]
    items[3]["vector"] = [0.0] * 4
    extra = [items[0] | dict(item_id=500, dataset="old"), items[0] | dict(item_id=501, model=None), items[0] | dict(item_id=502, vector=[1.0])]
    queries = [dict(query_id=q, text=rng.choice(["我有番茄炒蛋", "tofu bowl please", "rice"]), parts=pick(words, 2), scenarios=pick(["quick"], 1), terms=pick(["番茄", "bowl"], 2), dish_terms=pick(["bowl", "蛋"], 1), diets=pick(["vegan"], 1), excluded=pick(words, 1), max_minutes=rng.choice([None, 30.0]), limit=rng.choice([None, 60.0]), preference=rng.choice([None, 0.5]), vector=[rng.choice([0.0, 1.0, 0.5]) for _ in range(4)]) for q in range(8)]
    queries.append(queries[0] | dict(query_id=99, diets=["no such"]))
    expected = []
    for q in queries:
        ok = [i for i in items if set(q["diets"]) <= set(i["diets"]) and not set(q["excluded"]) & set(i["parts"]) and (q["limit"] is None or i["minutes"] <= q["limit"])]
        lanes = [sorted(ok, key=lambda i: (-rule(i, q), i["item_id"]))[:10], sorted(ok, key=lambda i: (-round(cosine(i["vector"], q["vector"]), 6), i["item_id"]))[:10]]
        fused = {}
        for lane, weight in zip(lanes, (10.0, 1.0)):
            for rank, i in enumerate(lane, 1):
                fused[i["item_id"]] = fused.get(i["item_id"], 0.0) + weight / (60 + rank)
        ranked = []
        for key, value in fused.items():
            i = items[key]
            coverage = len(set(i["parts"]) & set(q["parts"])) / len(q["parts"]) if q["parts"] else 0.0
            score = round(round(value, 8) + coverage * 0.02 + 0.005 * len(set(i["scenarios"]) & set(q["scenarios"])) + i["quality"] * 0.0001, 6)
            ranked.append((-score, key))
        expected += [(q["query_id"], key, rank) for rank, (_, key) in enumerate(sorted(ranked)[:5], 1)]
    columns = lambda rows, schema: [tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows]
    table = hybrid.in_scope(spark.createDataFrame(columns(items + extra, ITEM), ITEM).repartition(4), 4, dataset="v1", model="m")
    asked = spark.createDataFrame(columns(queries, QUERY), QUERY)
    out = hybrid.retrieve(table, asked, k=10)
    assert sorted(tuple(r) for r in out.select("query_id", "item_id", "rank").collect()) == sorted(expected) and 99 not in {e[0] for e in expected}
    monkeypatch.setattr(hybrid, "QUERY_BLOCK", 3)  # several blocks give the same
    assert sorted(tuple(r) for r in hybrid.retrieve(table, asked, k=10).select("query_id", "item_id", "rank").collect()) == sorted(expected)
    assert hybrid.retrieve(table.limit(0), asked).count() == 0


def test_lanes_by_matrices_and_by_columns(spark, tmp_path, monkeypatch):
    """Whole rows are scored in matrices, those with nulls, no numbers or another length by columns; both as columns alone would."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(7)
    words = [None, "leek", "rice", "tofu", "", "a b"]
    pick = lambda n: [rng.choice(words) for _ in range(rng.randint(0, n))]
    vector = lambda: [rng.choice([0.0, 1.0, -0.5]) for _ in range(3)]
    items = [[i, rng.choice(["Rice bowl", "rice", "!", "Tofu"]), pick(4), pick(2), pick(3), pick(2), float(rng.randint(5, 90)), rng.random(), vector(), "v1", "m"] for i in range(200)]
    queries = [[q, rng.choice(["rice bowl please", "tofu\nrice", ""]), pick(3), pick(2), pick(3), pick(2), pick(1), pick(1), rng.choice([None, 30.0]), rng.choice([None, 60.0]), rng.choice([None, 0.5]), vector()] for q in range(12)]
    for i, (at, value) in enumerate([(1, None), (2, None), (6, None), (6, float("nan")), (7, None), (8, None), (8, [1.0, None, 0.5]), (8, [1.0]), (8, [float("nan")] * 3), (5, None)]):
        items[10 * i][at] = value
    queries[2][2], queries[3][1], queries[4][11] = None, None, [1.0, None, 0.0]
    table, asked = spark.createDataFrame([tuple(r) for r in items], ITEM).repartition(3), spark.createDataFrame([tuple(r) for r in queries], QUERY)
    met = hybrid._met(table, asked).collect()
    met_odd, met_rows = hybrid._met, []
    monkeypatch.setattr(hybrid, "_met", lambda i, q: met_rows.append((i.count(), q.count())) or met_odd(i, q))
    lanes = dict(zip(("rule", "cosine"), hybrid.candidates(table, asked, k=7)))
    assert met_rows == [(10, 12), (190, 3)]
    for name, lane in lanes.items():
        best = lambda r: (r[name] is None, not (r[name] is not None and math.isnan(r[name])), -(r[name] or 0.0), r["item_id"])  # noqa: B023, E731
        expected = [(q[0], r["item_id"], n) for q in queries for n, r in enumerate(sorted((r for r in met if r["query_id"] == q[0]), key=best)[:7], 1)]
        assert sorted((r["query_id"], r["item_id"], r["rank"]) for r in lane.collect()) == sorted(expected)


def test_forwarding_of_expectations(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    expected = spark.createDataFrame([
        (1, "excluded", "egg", ["EGG", "eggs"]), (1, "excluded", "milk", ["milk"]), (1, "taste", "odd", None), (2, "diets", "vegan", ["vegan"]), (3, "diets", "vegan", []),
        (None, "diets", "vegan", ["vegan"]), (1, "excluded", "egg", ["egg"]), (5, "taste", "odd", None),
    ], "turn_id long, field string, value string, accepted array<string>")
    calls = spark.createDataFrame([(1, "a", "excluded", ["Eggs", None]), (1, "b", "excluded", ["egg"]), (3, "a", "diets", ["vegan"]), (None, "a", "diets", ["VEGAN"]), (4, "a", "diets", None)], "turn_id long, call string, field string, values array<string>")
    turns = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (6,), (None,)], "turn_id long")
    checks = forwarding.forwarded(expected, calls)
    got = sorted(((r["turn_id"] or 0, r["expected"], r["status"]) for r in checks.collect()))
    assert got == sorted([(1, "egg", "passed"), (1, "milk", "failed"), (1, "odd", "not_machine_checkable"), (2, "vegan", "failed"), (3, "vegan", "failed"), (0, "vegan", "passed"), (1, "egg", "passed"), (5, "odd", "not_machine_checkable")])
    status = {r["turn_id"]: (r["checks"], r["calls"], r["status"]) for r in forwarding.turn_status(turns, checks, calls).collect()}
    assert status == {1: (4, 2, "failed"), 2: (1, 0, "no_call"), 3: (1, 1, "failed"), 4: (0, 1, "passed"), 5: (1, 0, "no_call"), 6: (0, 0, "not_applicable"), None: (1, 1, "passed")}
    assert tuple(forwarding.forwarding_rate(checks).first()) == (6, 3, 3, 0.5) and forwarding.forwarding_rate(checks.limit(0)).first()["rate"] is None
    named = checks.select("turn_id", F.col("expected").alias("name"), F.when(F.col("status") != "not_machine_checkable", F.col("status") == "passed").alias("passed"))
    scores = {r["turn_id"]: (r["score"], r["critical"], r["violations"]) for r in forwarding.hard_constraints(turns, named).collect()}
    assert scores[1] == (0.6667, True, ["milk"]) and scores[4] == scores[5] == scores[6] == (1.0, False, []) and scores[None] == (1.0, False, [])
