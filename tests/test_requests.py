"""NFKC evidence, request counts, diversity, pinned versions, statuses and checksums on small fixtures."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import ranking
from millrace.functions import text as tx
from millrace.operators import versions
from millrace.sources import files
from millrace.streaming import states


def test_evidence_is_nfkc_lower_and_collapsed(spark):
    given = ["  A  b\tC ", "Ｆｕｌｌ\u3000Width", "ﬁne\u00a0Ⅳ", "", None, "番茄 Ｔ"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i long, t string").select("i", tx.evidence(F.col("t")).alias("e")).collect()
    found = {r["i"]: r["e"] for r in rows}
    for i, t in enumerate(given):
        assert found[i] == (None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).lower().strip()))


def test_requests_count_ids_or_keys(spark):
    df = spark.createDataFrame([([("Egg", 1), ("eggs", 1), ("Sea Salt", None), ("sea_salt", None), ("oil", None)],), ([],)], "r array<struct<name:string,id:long>>")
    assert [r[0] for r in df.select(tx.requested_count(F.col("r"))).collect()] == [3, 0]


def test_diversity(spark):
    rows = [("Try 家常Tofu and Tofu.", ["家常Tofu", "Tofu", "Rice"], True), ("nothing", ["a", "b", "b", "c"], True), ("x", ["a"], True), (None, None, True), ("x", ["a"], False)]
    df = spark.createDataFrame(rows, "answer string, names array<string>, asked boolean")
    assert [r[0] for r in df.select(ranking.diversity(F.col("answer"), F.col("names"), F.col("asked"))).collect()] == [0.5, 0.6667, 0.4, 0.4, 1.0]


def test_pinned_version(spark):
    df = spark.createDataFrame([("v1", "ACTIVE", "m", 3), ("v2", "EXPERIMENTAL", "m", 3), ("v3", "FAILED", "m", 3)], "version string, status string, model string, dimension int")
    assert versions.pinned(df, "v1", {"model": "m", "dimension": 3}).first()["version"] == "v1"
    assert versions.pinned(df, "v2", {"model": "m"}, experimental=True).count() == 1
    for version, metadata in (("v2", {}), ("v3", {}), ("v4", {}), ("v1", {"dimension": 4})):
        with pytest.raises(LookupError):
            versions.pinned(df, version, metadata)


def test_each_status_once(spark, tmp_path):
    rows = [(1, "find"), (1, "find"), (1, "a"), (1, "b"), (1, "draw"), (2, "web"), (2, None), (2, "find")]
    df = spark.createDataFrame(rows, "conv long, tool string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    named = {"find": "searching", "web": "searching_web"}
    wanted = [(1, "searching"), (1, "using_tool"), (2, "searching"), (2, "searching_web")]
    once = states.first_statuses(df, "conv", "tool", named, ["draw"])
    assert sorted((r["conv"], r["status"]) for r in once.collect()) == wanted
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = states.first_statuses(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "conv", "tool", named, ["draw"], late="1 hour")
    query = stream.writeStream.format("memory").queryName("statuses").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["conv"], r["status"]) for r in spark.sql("select * from statuses").collect()) == wanted


def test_checksums(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, body in (("a", b"abc"), ("d/b", b"\x00x"), ("empty", b"")):
        (tmp_path / name).write_bytes(body)
    found = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in files.checksums(spark, str(tmp_path)).collect()}
    assert found == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in (("a", b"abc"), ("b", b"\x00x"))}
