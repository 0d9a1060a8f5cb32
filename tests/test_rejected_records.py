"""Rejected records: the same as by the list of all pairs, but no list is made."""

import random

import pytest

from millrace.operators import review


@pytest.mark.parametrize("measure", ["sequence", "edit"])
def test_rejected_as_by_all_pairs(spark, tmp_path, measure):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(6)
    words = [f"part{i}" for i in range(30)]
    bases = [("Apple cake", rng.sample(words, 12), ["BAKE"]), ("apple cakes", [], []), ("Soup", rng.sample(words, 9), ["BOIL"]), ("", [], None), (None, None, ["FRY"])]
    rows = []
    for i in range(160):
        name, core, methods = rng.choice(bases)
        name = name and "".join(c for c in name if rng.random() < 0.95) + rng.choice(["", "", " b", " cd"])
        core = core and [c for c in core if rng.random() < 0.97] + rng.sample(["salt", "egg"], rng.choice([0, 0, 1]))
        rows.append((i, name, core, methods, f"step {rng.randrange(2)}"))
    rows += [(200, *rows[3][1:]), (None, *rows[5][1:]), (None, "only here", ["x"], [], "z"), (7, "twice", ["x"], [], "z")]
    table = spark.createDataFrame(rows, "ordinal long, name string, core array<string>, methods array<string>, steps string")
    known = review.pair_reviews(table, measure)
    across = known.where("decision = 'REJECT_RIGHT' and not same_name").count()
    expected = sorted((r["id"] is not None, r["id"] or 0) for r in review.rejected(table, known).collect())
    assert sorted((r["id"] is not None, r["id"] or 0) for r in review.rejected_records(table, measure).collect()) == expected and across > 20


def test_the_query_lists_no_pairs(spark, tmp_path, monkeypatch):
    def none(*_):
        raise AssertionError("all pairs of a name are listed")

    from millrace.plans import pairs

    spark.sparkContext.setCheckpointDir(str(tmp_path / "kept"))
    rows = [(i, f"Same name. long word sentences {i} follow", "en") for i in range(50)] + [(60, "Other title. something", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(review, "same_names", none)
    assert sorted(r["id"] for r in pairs.review_rejected(spark, str(tmp_path)).collect()) == list(range(1, 50))
