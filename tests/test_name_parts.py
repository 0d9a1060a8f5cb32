"""Name pairs by parts: names of few characters leave no bound but their order, and long ones have none of it."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from millrace.operators import names


@pytest.mark.parametrize("measure", ["sequence", "edit"])
def test_parts_blocks_and_long_names(spark, monkeypatch, measure):
    monkeypatch.setattr(names, "PART", 20)
    rng = random.Random(7)
    every = [(rng.choice("xy"), "".join(rng.choices("abc", k=rng.choice([9, 10, 30, 63, 64, 65, 70, 90])))) for _ in range(70)]
    every += [(k, n[:3] + "z" + n[4:-1]) for k, n in every[:50]]
    table = spark.createDataFrame(every, "kind string, name string")
    got = {(r["kind"], r["a"], r["b"]) for r in names.name_pairs(table, 0.8, measure, ["kind"]).collect()}

    def alike(a, b):
        if measure == "sequence":
            return max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b))

    known = sorted(set(every))
    assert got == {(k, a, b) for k, a in known for m, b in known if k == m and a < b and alike(a, b) >= 0.8} and len(got) >= 40


def test_names_of_like_letters_are_not_candidates():
    rng = random.Random(8)
    words = ["".join(rng.sample("aaabbbcccdddeeefffggg", 21)) for _ in range(300)]
    signs = names._Signs(words)
    # names of the same letters share all segments of a character; their order leaves hardly any
    assert sum(len(i) for i, _ in signs.alike(signs, "sequence", 0.78, True)) < 100
    a, b = np.array([0]), np.array([1])
    table = np.zeros((22, 22), int)
    x, y = signs.names[0], signs.names[1]
    for i in range(21):
        for j in range(21):
            table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
    assert signs.in_order(a, signs, b)[0] == table[21, 21]
