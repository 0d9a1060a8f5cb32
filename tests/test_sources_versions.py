"""JSON lines and table versions on small fixtures."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import versions
from millrace.sources import jsonl

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("size", T.IntegerType())])


def test_tolerant_reading_keeps_the_good_rows(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": "a", "size": 1}\n\n{"id": "b", "size": "x"}\nnot json\n{"id": null, "size": 3}\n')
    good, bad = jsonl.read_tolerant(spark, str(tmp_path / "in.jsonl"), SCHEMA)
    assert sorted(r["size"] for r in good.collect()) == [1, 3]
    assert {r["code"] for r in bad.collect()} == {"SOURCE_PARSE_FAILED"} and bad.count() == 2
    ids = jsonl.with_record_id(good, "id", "size").orderBy("size").collect()
    assert [r["record_id"] for r in ids] == ["a", "manual-record-3"]
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(tmp_path / "in.jsonl"), SCHEMA).collect()


def test_written_rows_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], SCHEMA)
    jsonl.write(df, str(tmp_path / "out"))
    assert {tuple(r) for r in jsonl.read_strict(spark, str(tmp_path / "out"), SCHEMA).collect()} == {("a", 1), ("b", None)}
    assert T.StructType.fromJson(__import__("json").loads(spark.read.text(str(tmp_path / "out.schema")).first()[0])) == df.schema


def test_changes_and_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(2, ""), (3, "c"), (4, "d")], "k long, v string")
    assert {tuple(r) for r in versions.changes(old, new, "k", ["v"]).collect()} == {(1, "removed"), (2, "updated"), (3, "unchanged"), (4, "inserted")}
    assert {tuple(r) for r in versions.upsert(old, new, "k").collect()} == {(1, "a"), (2, ""), (3, "c"), (4, "d")}
    assert {tuple(r) for r in versions.insert_missing(old, new, "k").collect()} == {(1, "a"), (2, None), (3, "c"), (4, "d")}
    lines = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k long, v string")
    fresh = spark.createDataFrame([(1, "n")], "k long, v string")
    assert {tuple(r) for r in versions.replace_children(lines, fresh, "k").collect()} == {(1, "n"), (2, "z")}


def test_one_version_is_active(spark):
    df = spark.createDataFrame([("v1", "ACTIVE"), ("v2", "VALIDATED"), ("v3", "EXPERIMENTAL")], "version string, status string")
    state = lambda d: {r["version"]: r["status"] for r in d.select("version", F.col("status")).collect()}
    assert state(versions.activate(df, "v2")) == {"v1": "INACTIVE", "v2": "ACTIVE", "v3": "EXPERIMENTAL"}
    assert state(versions.activate(df, "v3")) == state(df)


def test_any_parser_with_its_faults_as_rows(spark, tmp_path):
    from pyspark.sql import types as T

    from millrace.sources import records

    spark.sparkContext.setCheckpointDir(str(tmp_path))

    def parser(record):
        return {"name": record["title"].strip(), "n": record.get("n")}

    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])
    lines = ['{"title": " a ", "n": 1}', '{"n": 2, "id": "own"}', '{"title": 3}', "not json", "[1]", '{"title": "é", "n": "x"}', None, '{"title": "b"}']
    table = spark.createDataFrame([(i + 1, v, "x") for i, v in enumerate(lines)], "ordinal long, value string, name string")
    rows, rejected = records.parsed(table, parser, schema)
    assert sorted(map(tuple, rows.collect()), key=repr) == [("a", 1), ("b", None)]
    found = {r["record_id"]: r["message"].split(":")[0] for r in rejected.collect()}
    assert found.pop("own") == "KeyError" and found.pop("public-record-3") == "AttributeError" and rejected.count() == 6
    assert {k: v for k, v in found.items() if k} == {"public-record-4": "JSONDecodeError", "public-record-5": "ValueError", "public-record-7": "TypeError"}
    empty, none = records.parsed(table.limit(0), parser, schema)
    assert empty.count() == none.count() == 0


def test_made_records_and_image_signatures(spark):
    from pyspark.sql import functions as F

    from millrace.sources import records

    out = records.made(spark, ["SOUP", "CAKE"], 3, {"minutes": F.col("number") * 10}).collect()
    assert sorted(r["record_id"] for r in out) == ["synthetic-cake-001", "synthetic-cake-002", "synthetic-cake-003", "synthetic-soup-001", "synthetic-soup-002", "synthetic-soup-003"] and {r["minutes"] for r in out} == {10, 20, 30}
    for bad in (0, 11):
        with pytest.raises(ValueError):
            records.made(spark, ["SOUP"], bad, {})
    images = [(b"\xff\xd8\xff\xe0", "image/jpeg"), (b"\x89PNG\r\n\x1a\n rest", "image/png"), (b"RIFF1234WEBPVP8", "image/webp"), (b"RIFF1234WAVE", None), (b"\x89PNG", None), (b"", None), (None, None)]
    table = spark.createDataFrame([(bytearray(b) if b is not None else None, k) for b, k in images], "data binary, kind string")
    got = table.select("kind", records.image_type(F.col("data")).alias("t"), records.signature_fits(F.lit("IMAGE/PNG"), F.col("data")).alias("png")).collect()
    assert all(r["kind"] == r["t"] for r in got) and [r["png"] for r in got] == [False, True, False, False, False, False, False]
