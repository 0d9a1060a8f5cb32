"""Kinds of one name: their texts go by parts of the name's kinds, not by pairs."""

import random
from decimal import ROUND_HALF_UP, Decimal

from millrace.operators import review


def test_all_pairs_of_a_name_in_parts(spark, monkeypatch):
    monkeypatch.setattr(review, "PART", 4)
    monkeypatch.setattr(review, "GRAMS", 7)
    rng = random.Random(2)
    kinds = [(100 - i, f"n{i % 3}" if i < 45 else "" if i < 47 else "alone", rng.sample("abcdef", i % 5), ["m"] * (i % 2), "".join(rng.choices("abc红", k=i % 30))) for i in range(48)]
    table = spark.createDataFrame(kinds, "ordinal long, name_key string, core array<string>, methods array<string>, steps string")

    def jaccard(a, b):
        return float(Decimal(repr(len(a & b) / len(a | b))).quantize(Decimal("0.0001"), ROUND_HALF_UP)) if a | b else 1.0

    def grams(x):
        return {x[k : k + 3] for k in range(len(x) - 2)}

    expected = {
        (i, j, True, 1.0, jaccard(set(c), set(d)), jaccard(set(m), set(o)), jaccard(grams(s), grams(t)), "REJECT_RIGHT")
        for i, a, c, m, s in kinds for j, b, d, o, t in kinds if i < j and a == b
    }
    got = [tuple(r) for r in review.same_names(table).collect()]
    assert set(got) == expected and len(got) == len(expected) == 3 * 105 + 1
