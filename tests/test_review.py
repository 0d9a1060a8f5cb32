"""Name joins and pair reviews against comparing every pair."""

import random
import re
from difflib import SequenceMatcher

import pytest

from millrace.operators import names, review, similarity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ratio(measure, a, b):
    if measure == "sequence":
        return SequenceMatcher(None, a, b).ratio()
    return 1 - edits(a, b) / max(len(a), len(b)) if a or b else 1.0


def changed(rng, name):
    name = list(name)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(name) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            name.insert(at, rng.choice("abcdé红"))
        elif name and at < len(name):
            if kind == 1:
                del name[at]
            else:
                name[at] = rng.choice("abcdé红")
    return "".join(name)


@pytest.mark.parametrize("measure, threshold", [("sequence", 0.78), ("sequence", 0.68), ("edit", 0.78), ("edit", 0.7), ("sequence", 1.0)])
def test_name_pairs_against_all_pairs(spark, measure, threshold):
    rng = random.Random(5)
    found = {"".join(rng.choice("abcdefé红烧") for _ in range(rng.randint(1, 22))) for _ in range(60)}
    found |= {changed(rng, n) for n in list(found) for _ in range(3)} | {"", "a", "b", "ab"}
    table = spark.createDataFrame([(n, "x") for n in found] + [(None, "x"), ("ab", "x")], "name string, a string")
    got = {(r["a"], r["b"]) for r in names.name_pairs(table, threshold, measure).collect()}
    every = sorted(n for n in found if n)
    expected = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if max(ratio(measure, a, b), ratio(measure, b, a)) >= threshold}
    assert {tuple(sorted(p)) for p in got} == expected and (len(expected) > 60 or threshold == 1.0)
    assert names.name_pairs(table.limit(0), threshold, measure).count() == 0


def test_too_low_a_threshold_is_refused(spark):
    with pytest.raises(ValueError):
        names.name_pairs(spark.createDataFrame([("a",)], "name string"), 0.5)


def test_set_pairs_keep_copies_and_empty_sets(spark):
    rng = random.Random(9)
    sets = [(i, rng.choice("xy"), [rng.choice("abcdefghij") for _ in range(rng.randint(0, 7))]) for i in range(80)]
    sets += [(100 + i, "x", ["a", "b", "c"]) for i in range(12)] + [(200, "y", None), (201, "y", [])]
    table = spark.createDataFrame(sets, "id long, kind string, elements array<string>")
    for threshold in (0.5, 0.65, 0.9):
        expected = set()
        for i, k, a in sets:
            for j, m, b in sets:
                a_, b_ = set(a or []), set(b or [])
                alike = len(a_ & b_) / len(a_ | b_) if a_ | b_ else 1.0
                if i < j and k == m and alike >= threshold:
                    expected.add((i, j, round(alike, 6)))
        assert set(map(tuple, similarity.set_pairs(table, ["kind"], threshold).collect())) == expected


def plain(x):
    return re.sub("[^0-9a-z一-鿿]", "", (x or "").lower())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def records():
    rng = random.Random(11)
    base = [("Mapo Tofu", ["tofu", "pork", "chili"], ["FRY"]), ("家常麻婆豆腐", ["tofu", "pork", "chili"], ["FRY"]), ("麻婆豆腐", ["tofu", "pork", "chili", "leek"], ["FRY"]), ("Apple cake", ["apple", "flour"], ["BAKE"]), ("apple-cake", ["pear"], []), ("", None, None), (None, [], []), ("Pear cake", ["pear", "flour", "egg"], ["BAKE"])]
    rows = [(i, *b, f"step {rng.randrange(4)} of the dish") for i, b in enumerate(base)]
    for i in range(8, 60):
        name, core, methods = rng.choice(base)
        core = [c for c in core or [] if rng.random() < 0.85] + rng.sample(["salt", "egg", "oil"], rng.randint(0, 1))
        rows.append((i, changed(rng, name or ""), core, methods, f"step {rng.randrange(4)} of the dish"))
    return rows + [(60, *rows[0][1:]), (61, *rows[0][1:]), (62, *rows[3][1:])]


@pytest.mark.parametrize("measure", ["sequence", "edit"])
def test_reviews_against_all_pairs(spark, records, tmp_path, measure):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    kinds, kind_of = {}, {}
    for i, name, core, methods, steps in records:
        key = plain(name), frozenset(core or []), frozenset(methods or []), plain(steps)
        kind_of[i] = kinds.setdefault(key, i)
    expected, bad = set(), {i for i, k in kind_of.items() if i != k}
    every = sorted((i, k) for k, i in kinds.items())
    for x, (i, a) in enumerate(every):
        for j, b in every[x + 1 :]:
            name, parts, methods = ratio(measure, a[0], b[0]), jaccard(a[1], b[1]), jaccard(a[2], b[2])
            if a[0] == b[0] or (parts >= 0.8 and methods >= 0.99 and name >= 0.55):
                decision = "REJECT_RIGHT"
            elif (parts >= 0.65 and methods >= 0.99) or name >= 0.78:
                decision = "HUMAN_REVIEW"
            else:
                continue
            if name < 0.45 and parts < 0.5:
                continue
            grams = [{k[3][n : n + 3] for n in range(max(0, len(k[3]) - 2))} for k in (a, b)]
            expected.add((i, j, a[0] == b[0], round(name, 4), round(parts, 4), round(methods, 4), round(jaccard(*grams), 4), decision))
            if decision == "REJECT_RIGHT":
                bad |= {r for r, k in kind_of.items() if k == j}
    table = spark.createDataFrame(records, "ordinal long, name string, core array<string>, methods array<string>, steps string")
    out = review.pair_reviews(table, measure)
    assert set(map(tuple, out.collect())) == expected and {e[-1] for e in expected} == {"REJECT_RIGHT", "HUMAN_REVIEW"}
    assert {r["id"] for r in review.rejected(table, out).collect()} == bad
    first = spark.createDataFrame([(i, "c", n, c) for i, n, c, _, _ in records], "ordinal long, category string, name string, core array<string>")
    near = [(i, j) for i, a, c, _, _ in records for j, b, d, _, _ in records if i < j and a is not None and b is not None and jaccard(set(c or []), set(d or [])) >= 0.65 and ratio(measure, a, b) >= 0.6]
    assert [tuple(r) for r in review.first_near_pairs(first, measure=measure).collect()] == sorted(near)[:20]
