"""Caches of vectors, decoded replies, nested values, memories, frames and restructured records on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import replies
from millrace.operators import cache, memories, querysets, restructure
from millrace.streaming import frames

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def computing():
    """A function that goes to the workers by value."""

    def compute(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    return compute


compute = computing()


def test_cache_computes_once_and_loses_only_the_bad_item(spark, tmp_path):
    root = str(tmp_path / "cache")
    texts = [f"text {i % 40}" for i in range(60)] + ["bad one", None, "", "x" * 50_000]
    items = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "id long, text string, run string").repartition(3)
    out, stats = cache.cached(items, root, compute, "m1", batch=8)
    rows = {r["id"]: r for r in out.collect()}
    assert len(rows) == len(texts) and out.columns == ["id", "text", "run", "vector", "error"]
    assert {i: r["error"] for i, r in rows.items() if r["error"]} == {60: "RuntimeError"} and rows[60]["vector"] is None
    assert all(r["vector"] == [float(len(r["text"] or "")), 1.0] for i, r in rows.items() if i != 60)
    assert (stats["hits"], stats["misses"], stats["writes"], stats["failures"]) == (0, 43, 42, 1)
    again, stats = cache.cached(items, root, compute, "m1", batch=8)
    assert (stats["hits"], stats["misses"], stats["failures"], stats["requests"]) == (42, 1, 1, 1) and again.count() == len(texts)
    more, stats = cache.cached(items.limit(0).union(spark.createDataFrame([(1, "new", "r"), (2, "text 1", "r")], items.schema)), root, compute, "m1")
    assert (stats["hits"], stats["misses"], stats["requests"]) == (1, 1, 1) and more.where("vector is null").count() == 0
    for other in ({"model": "m2"}, {"model": "m1", "kind": "query"}, {"model": "m1", "template": "v2"}):
        assert cache.cached(spark.createDataFrame([(1, "text 1", "r")], items.schema), root, compute, **other)[1]["misses"] == 1
    assert cache.cached(items.limit(0), root, compute, "m1")[1] == {"hits": 0, "misses": 0, "writes": 0, "failures": 0, "requests": 0}


def test_bisection_counts_its_requests():
    texts = ["a", "b", "bad", "c", "d", "e", "f", "g"]
    out, requests = cache.bisected(texts, compute)
    assert [e for _, e in out] == [None, None, "RuntimeError", None, None, None, None, None] and requests == 7
    wrong = lambda t: [[1.0] * (2 if "odd" in x else 3) for x in t]
    assert [e for _, e in cache.bisected(["a", "odd"], wrong, 3)[0]] == [None, "ValueError"]
    assert [e for _, e in cache.bisected(["a", "b"], lambda t: [[1.0]])[0]] == [None, None]  # each alone has its vector
    assert cache.bisected(["a"], lambda t: [[float("nan")]])[0] == [(None, "ValueError")] and cache.bisected([], compute) == ([], 0)


REPLIES = {
    '[{"name":"a","n":1},{"name":"b"}]': None, '{"recipes":[{"name":"a","tags":["x"]},{"name":"b"}]}': None, ' [ {"name":"a"} , {"name":"b","n":null} ] ': None,
    '{"recipes":[{"name":"a"}],"more":1}': "root", '3': "root", '"s"': "root", '{}': "root", '[{"name":"a"}]': "count", '[]': "count",
    '[{"name":"a"},{"n":1}]': "item", '[{"name":"a"},{"name":"b","n":"x"}]': "item", '[{"name":"a"},{"name":"b","z":1}]': "item", '[1,2]': "item", '{"recipes":3}': "item",
    '[{"name":null},{"name":"b"}]': "item", '[{"name":3},{"name":"b"}]': "item", '[[],{}]': "item",
    'not json': "json", '[{"name":"a"},{"name":"b"}] tail': "json", '[{"name":"a"},{"name":"b"': "json", '[{"name":"a"},{"name":"b"}] [1]': "json", None: "json", '': "json",
}


def test_replies_are_decoded_whole_or_not_at_all(spark):
    item = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("n", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    table = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "id int, reply string")
    out = {r["id"]: r for r in replies.decoded(table, item, F.lit(2), "recipes").collect()}
    assert [out[i]["error"] for i in range(len(REPLIES))] == list(REPLIES.values())
    assert all((out[i]["items"] is None) == (e is not None) for i, e in enumerate(REPLIES.values())) and [x["name"] for x in out[0]["items"]] == ["a", "b"]


def walked_plainly(value, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            yield path, k, None if isinstance(v, (dict, list)) or v is None else json.dumps(v, ensure_ascii=False).strip('"')
            yield from walked_plainly(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walked_plainly(v, f"{path}[{i}]")


def test_walk_of_values_of_any_depth(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(6) if depth else rng.randrange(3)
        if kind > 3:
            return {f"k{rng.randrange(5)}": value(depth - 1) for _ in range(rng.randint(0, 3))}
        if kind == 3:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return [None, rng.randrange(9), "té"][kind]

    values = [value(5) for _ in range(60)] + [{"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}}, 5]
    table = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)] + [(999, None)], "id int, j string").select("id", F.try_parse_json("j").alias("v"), F.lit(1).alias("key"))
    expected = sorted(((i, *row) for i, v in enumerate(values) for row in walked_plainly(v)), key=repr)
    assert sorted(map(tuple, replies.walked(table, "id", "v").collect()), key=repr) == expected and len(expected) > 40
    assert replies.walked(table.limit(0), "id", "v").count() == 0


def test_memories_equal_one_candidate_at_a_time(rocks, tmp_path):
    rng = random.Random(8)
    schema = "owner long, key string, seq long, action string, kind string, value string, confidence double"
    rows = [(rng.choice([1, 2, None]), rng.choice(["diet", " Diet ", "sport", "  ", None, "k" * 81]), i, rng.choice(["UPSERT", "UPSERT", "DELETE"]), rng.choice(["DIETARY_RESTRICTION", "FOOD_PREFERENCE"]), rng.choice(["nuts", "Nuts", " a   b ", "", None]), rng.choice([0.5, 0.8, 0.9, 0.97999, 0.98, 1.0, None])) for i in range(400)]
    held = {}
    for owner, key, seq, action, kind, value, confidence in rows:
        key = " ".join((key or "").lower().split())
        if key and len(key) <= 80:
            held[owner, key] = memories.applied(held.get((owner, key)), seq, action, kind, value, confidence)
    expected = sorted(((*k, *m) for k, m in held.items() if m), key=repr)
    table = rocks.createDataFrame(rows, schema).repartition(3)
    assert sorted(map(tuple, memories.remembered(table).collect()), key=repr) == expected and len(expected) == 6
    # rules by hand: a sensitive memory needs .98 to change or go, and keeps its kind
    safe = memories.applied(None, 1, "UPSERT", "DIETARY_RESTRICTION", "nuts", 0.85)
    assert memories.applied(safe, 2, "UPSERT", "FOOD_PREFERENCE", "milk", 0.97) is safe and memories.applied(safe, 2, "DELETE", "", "", 0.9) is safe
    assert memories.applied(safe, 2, "UPSERT", "FOOD_PREFERENCE", "milk", 0.98) == ("DIETARY_RESTRICTION", "milk", 0.98, True, 2)
    assert memories.applied(safe, 2, "UPSERT", "DIETARY_RESTRICTION", "NUTS", 0.8) == ("DIETARY_RESTRICTION", "nuts", 0.85, True, 2)
    assert not memories.applied(safe, 2, "DELETE", "", "", 0.99).active and memories.applied(None, 1, "DELETE", "", "", 1.0) is None
    source = str(tmp_path / "in")
    for part in range(3):
        rocks.createDataFrame(rows[part * 150 : (part + 1) * 150], schema).coalesce(1).write.mode("append").parquet(source)
        stream = memories.remembered_stream(rocks.readStream.schema(schema).parquet(source))
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    last = rocks.read.parquet(str(tmp_path / "out")).groupBy("owner", "key").agg(F.max_by(F.struct("kind", "value", "confidence", "active", "changed"), F.struct("n", "changed")).alias("m")).select("owner", "key", "m.*")
    assert sorted(map(tuple, last.collect()), key=repr) == expected


def test_frames_from_pieces_cut_anywhere(rocks, tmp_path):
    rng = random.Random(4)
    rows, expected = [], []
    for source in range(6):
        end = ["\n", "\r\n", "\r"][source % 3]
        sent = [(rng.choice(["token", "done", None]), "\n".join(rng.choice(["a: b", "", " x", "é", '{"k":1}']) for _ in range(rng.randint(1, 3)))) for _ in range(15)]
        lines = []
        for event, data in sent:
            lines += ([f"event: {event}"] if event else []) + [": note"] * (rng.random() < 0.2) + [f"data: {x}" for x in data.split("\n")] + [""]
        lines[0:0] = ["event: nothing", ""]  # a frame without data
        whole = end.join(lines) + end + "event: open" + end + "data: left"
        expected += [(str(source), n, event or "message", data) for n, (event, data) in enumerate(sent, 1)]
        at, seq = 0, 0
        while at < len(whole):
            size = rng.randint(0, 12)
            rows.append((str(source), seq, whole[at : at + size] or None))
            at, seq = at + size, seq + 1
    schema = "source string, seq long, piece string"
    rng.shuffle(rows)
    assert sorted(map(tuple, frames.joined(rocks.createDataFrame(rows, schema)).collect())) == sorted(expected)
    source, ordered = str(tmp_path / "in"), sorted(rows, key=lambda r: r[1])
    for part in range(3):
        rocks.createDataFrame([r for i, r in enumerate(ordered) if i * 3 // len(ordered) == part], schema).coalesce(1).write.mode("append").parquet(source)
        query = frames.joined_stream(rocks.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(map(tuple, rocks.read.parquet(str(tmp_path / "out")).select("source", "n", "event", "data").collect())) == sorted(expected)


def test_frames_of_files_come_back(spark, tmp_path):
    events = [("token", "a"), ("token", 'two\nlines: "x"'), ("done", "")] * 200
    table = spark.createDataFrame(events, "event string, data string").repartition(3)
    frames.write_frames(table, str(tmp_path / "f"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")  # splits inside frames
    try:
        assert sorted(map(tuple, frames.read_frames(spark, str(tmp_path / "f")).collect())) == sorted(events)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_restructured_or_rejected(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    entries = spark.createDataFrame([("1", "tomato", ["Toma to", "pomodoro"]), ("2", "egg", None), ("3", "rice", ["grain"]), ("4", "oats", ["grain"])], "id string, name string, aliases array<string>")
    schema = "record_id long, ingredients array<struct<name:string,unit:string>>, steps array<struct<ordinal:int,ingredient_names:array<string>>>, keep string"
    raw = [
        (1, [("To-Mato", "g"), (" EGG ", None)], [(1, ["egg", "pomodoro", "Egg"]), (2, None)], "x"),
        (2, [("tomato", "g")], [(1, ["egg"])], "x"), (3, [("stone", "g"), ("flint", "g")], [(1, ["egg"])], "x"), (4, [("grain", "g")], [], "x"),
        (5, None, None, "x"), (1, [("egg", "g")], [(1, ["moon"])], "twin"), (6, [(None, "g")], [], None), (None, [("rice", "g")], [(1, [])], None),
    ]
    records, issues = restructure.restructured(spark.createDataFrame(raw, schema), entries)
    found = {r["record_id"]: r for r in records.collect()}
    assert set(found) == {1, 5, None} and found[1]["keep"] == "x" and found[5]["ingredients"] == [] and found[None]["ingredients"][0]["id"] == "3"
    assert [(i["name"], i["unit"], i["id"], i["normalized_name"]) for i in found[1]["ingredients"]] == [("To-Mato", "g", "1", "tomato"), (" EGG ", None, "2", "egg")]
    assert [s["ingredient_refs"] for s in found[1]["steps"]] == [["2", "1"], []]
    told = sorted(((r["record_id"], r["message"], r["path"]) for r in issues.collect()), key=repr)
    assert told == sorted([(2, "step 1 names an ingredient that the record has not: egg", "steps"), (3, "unknown ingredient: stone", "ingredients"), (4, "unknown ingredient: grain", "ingredients"), (1, "unknown ingredient: moon", "steps"), (6, "unknown ingredient: null", "ingredients")], key=repr)
    assert {r["code"] for r in issues.collect()} == {"RECIPE_TRANSFORM_FAILED"}


def test_query_sets_skip_repeats_while_kinds_go_in_turn(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(3)
    items = [(i * 3, [rng.choice([None, f"{k} {rng.randrange(40)}"]) for k in "abcde"]) for i in range(2001)]
    table = spark.createDataFrame(items, "item_id long, texts array<string>")
    ordered = items[::2] + items[1::2]
    for spread in (1, 7):
        found = querysets.strided(table.repartition(spread), "item_id")
        assert [r["item_id"] for r in found.orderBy("ordinal").collect()] == [i for i, _ in ordered]
        expected, seen = [], set()
        for item, texts in ordered:
            text = texts[len(expected) % 5]
            if text is not None and text not in seen and len(expected) < 125:
                seen.add(text)
                expected.append((len(expected) + 1, "abcde"[len(expected) % 5], text, item))
        out = querysets.query_sets(found, list("abcde"))
        assert [tuple(r) for r in out.orderBy("number").select("number", "kind", "query", "item_id").collect()] == expected and len(expected) == 125
        assert out.where("split = 'development'").count() == 50 and expected[-1][3] != ordered[124][0]
    with pytest.raises(ValueError):
        querysets.query_sets(found.where("ordinal < 60"), list("abcde"))
    with pytest.raises(ValueError):
        querysets.query_sets(found.limit(0), list("abcde"))
