"""The first near pairs are found from the first records, whatever comes after them."""

import random

import pytest

from millrace.operators import review, similarity


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "ordinal long, category string, name string, core array<string>")


def test_early_pairs_need_no_join_of_all_sets(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))

    def refuse(*args, **kwargs):
        raise AssertionError("all sets were joined")

    monkeypatch.setattr(similarity, "set_pairs", refuse)
    rows = [(i, "c", f"dish {i // 2}", [f"a{i // 2}", "b"]) for i in range(300)]
    got = [tuple(r) for r in review.first_near_pairs(rows_of(spark, rows), measure="edit", ingredients=0.9, name=0.99).collect()]
    assert got == [(i, i + 1) for i in range(0, 40, 2)]


@pytest.mark.parametrize("measure", ["edit", "sequence"])
def test_late_and_few_pairs_are_found(spark, tmp_path, monkeypatch, measure):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(review, "FIRST_LEFTS", 4)
    rng = random.Random(3)
    rows = [(i, rng.choice("xy"), "".join(rng.choices("abcdefghijklmnop", k=12)), [f"w{i}a", f"w{i}b"]) for i in range(60)]
    rows += [(100 + i, "x", f"the same dish {i % 3}", ["p", "q"]) for i in range(5)] + [(200, "y", None, None), (201, "y", "", []), (202, "y", "", None)]
    expected = [(100 + i, 100 + j) for i in range(5) for j in range(i + 1, 5)] + [(201, 202)]
    for most in (8, 2_000):  # with and without the join of what is left
        monkeypatch.setattr(review, "MOST_LEFTS", most)
        assert [tuple(r) for r in review.first_near_pairs(rows_of(spark, rows), measure=measure).collect()] == expected
    assert [tuple(r) for r in review.first_near_pairs(rows_of(spark, rows), measure=measure, first=3).collect()] == expected[:3]
    assert review.first_near_pairs(rows_of(spark, rows).limit(0), measure=measure).count() == 0
