"""Swaps that fail leave the table, readers keep what they read, progress holds only for what it was made of."""

import threading

import pytest
from pyspark.sql import functions as F

from millrace.operators import progress
from millrace.sources import versions


def test_swap_rollback_and_failures(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(ValueError):
        versions.read(spark, root)
    one = spark.range(10)
    assert versions.swap(one, root, [versions.at_least(5), versions.unique("id")], {"run": "a"}) == 1
    reader = versions.read(spark, root)
    assert versions.swap(spark.range(20), root) == 2
    assert reader.count() == 10 and versions.read(spark, root).count() == 20 and versions.read(spark, root, 1).count() == 10
    with pytest.raises(versions.Rejected):
        versions.swap(spark.range(3), root, [versions.at_least(5)])
    with pytest.raises(versions.Rejected):
        versions.swap(spark.range(9).select((F.col("id") % 2).alias("id")), root, [versions.unique("id")])
    with pytest.raises(Exception):
        versions.swap(spark.range(9).select(F.raise_error(F.lit("broken row")).cast("long").alias("id")), root)
    with pytest.raises(versions.Conflict):
        versions.swap(spark.range(1), root, based_on=1)
    assert versions.read(spark, root).count() == 20 and versions.latest(spark, root)["version"] == 2
    told = {(r["stage"], r["error"].split(":")[0]) for r in versions.failures(spark, root).collect()}
    assert {t[0] for t in told} == {"stage", "check", "commit"} and ("check", "Rejected") in told and versions.failures(spark, root).count() == 4
    assert len(list((tmp_path / "table" / "data").iterdir())) == 2  # nothing staged is left
    assert versions.rollback(spark, root, 1) == 3 and versions.read(spark, root).count() == 10
    assert [c["version"] for c in versions.commits(spark, root)] == [1, 2, 3]
    versions.vacuum(spark, root, keep=1)
    assert versions.read(spark, root).count() == 10


def test_of_writers_at_once_one_commits(spark, tmp_path):
    root, done = str(tmp_path / "table"), []
    versions.swap(spark.range(1), root)

    def write(n):
        try:
            done.append(versions.swap(spark.range(n), root, based_on=1))
        except versions.Conflict:
            done.append(None)

    seen = []
    threads = [threading.Thread(target=write, args=(n,)) for n in (2, 3, 4)]
    for t in threads:
        t.start()
    while any(t.is_alive() for t in threads):
        seen.append(versions.read(spark, root).count())
    for t in threads:
        t.join()
    assert sorted(done, key=str) == [2, None, None] and versions.failures(spark, root).count() == 2
    assert set(seen) <= {1, 2, 3, 4} and len(set(seen)) <= 2


TURNS = "conv_id long, turn long, role string, text string"


def told(df):
    return sorted((r["conv_id"], r["turn"], r["restarted"]) for r in df.collect())


def test_only_new_turns_are_pending_and_changed_ones_start_anew(spark):
    then = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", None), (3, 0, "user", "d"), (4, 0, "user", "e"), (4, 1, "user", "f")]
    state = progress.advanced(spark.createDataFrame(then, TURNS))
    now = [*then[:2], (1, 2, "user", "new"), (2, 0, "user", "C"), then[3], (2, 2, "user", "g"), then[4], (5, 0, "user", "h"), (4, 1, "user", "f")]
    out = told(progress.pending(spark.createDataFrame(now, TURNS), state))
    assert out == [(1, 2, False), (2, 0, True), (2, 1, True), (2, 2, True), (4, 1, True), (5, 0, False)]
    assert told(progress.pending(spark.createDataFrame(then, TURNS), state)) == []
    assert len(told(progress.pending(spark.createDataFrame(now, TURNS), state.limit(0)))) == len(now)


def test_a_resumed_run_does_only_what_is_pending(spark, tmp_path):
    root, seen = str(tmp_path / "run"), spark.sparkContext.accumulator(0)

    def work(rows):
        def each(batches):
            for b in batches:
                seen.add(len(b))
                yield b[["conv_id", "turn", "text"]].assign(text=b["text"].str.upper())

        return rows.mapInPandas(each, "conv_id long, turn long, text string")

    then = [(c, t, "user", f"text {c} {t}") for c in range(20) for t in range(3)]
    meta = {"strategy": "hybrid", "model": "m1", "dataset": "v1"}
    first = progress.resume(spark.createDataFrame(then, TURNS), root, work, meta)
    assert first.count() == 60
    before = seen.value
    now = [(c, t, r, "changed") if (c, t) == (7, 1) else (c, t, r, x) for c, t, r, x in then if c != 9] + [(1, 3, "user", "more")]
    with pytest.raises(progress.OtherRun):
        progress.resume(spark.createDataFrame(now, TURNS), root, work, meta | {"model": "m2"})
    second = progress.resume(spark.createDataFrame(now, TURNS), root, work, meta)
    expected = sorted((c, t, x.upper()) for c, t, _, x in now)
    assert sorted(map(tuple, second.select("conv_id", "turn", "text").collect())) == expected
    assert before >= 60 and seen.value - before <= 8  # four rows, at most once for the results and once for the check
