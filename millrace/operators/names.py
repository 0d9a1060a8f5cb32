"""Similarity join on names: parts of the names meet in tasks, bounds leave few pairs, which are then verified."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names alike by less are too many to be listed.
LEAST_THRESHOLD = 0.67


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / (|a| + |b|), M the characters in matching blocks, longest block first (the standard library's measure)."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty names, null if one is null."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def ratio(measure: str, a: Column, b: Column) -> Column:
    return {"sequence": sequence_ratio, "edit": edit_ratio}[measure](a, b)


def _edits(measure: str, threshold: float, short: Column, long: Column) -> Column:
    """Most edits between names of these lengths that reach the threshold.

    sequence: the blocks are a common subsequence, so what lies outside them is inserted or deleted.
    """
    total = short + long if measure == "sequence" else long
    return F.floor(total * (1 - threshold) + 1e-9).cast("int")


#: Names of one part, of which every two meet in one task, and parts at most; rows and columns of a matrix of names.
PART, MOST_PARTS = 2_000, 64
TILE = 1_024, 4_096
#: Characters are told apart by their number modulo this, which may only bring more candidates.
SIGNS = 64


def name_pairs(names: DataFrame, threshold: float, measure: str = "sequence", block: list[str] | None = None, name: str = "name") -> DataFrame:
    """(block.., a, b, similarity): all pairs of different names of one block with a similarity >= threshold, a < b.

    measure: `sequence` (matching blocks) or `edit` (edit distance). Lossless: names are dealt into parts, every two
    parts of a block meet in one task, and pairs are left out only by bounds: lengths, then the characters that both
    have (by matrix products), then their longest common subsequence, which neither measure's matches exceed. Pairs
    that are not alike so never leave a task; their number grows with the square of the names, memory with two parts.
    Null names are left out, repeated ones count once; an empty name is like no other.
    """
    if threshold < LEAST_THRESHOLD:
        raise ValueError(f"names must be alike by {LEAST_THRESHOLD} at least")
    block = block or []
    known = names.where(F.col(name).isNotNull() & (F.length(name) > 0)).select(*block, F.col(name).alias("_name")).distinct()
    parts = max(1, min(MOST_PARTS, -(-known.count() // PART)))
    known = known.withColumn("_part", F.pmod(F.xxhash64("_name"), F.lit(parts)).cast("int"))
    dealt = known.withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.select(*block, F.least("_part", "_with").alias("_low"), F.greatest("_part", "_with").alias("_high"), "_part", "_name")
    kept = [known.schema[c] for c in block]
    schema = T.StructType([*kept, T.StructField("_x", T.StringType()), T.StructField("_y", T.StringType())])
    width = max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
    met = dealt.repartition(width, *block, "_low", "_high").groupBy(*block, "_low", "_high").applyInArrow(lambda rows: _candidates(measure, threshold, block, rows), schema)
    met = met.select(*block, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))
    found = ratio(measure, F.col("a"), F.col("b"))
    if measure == "sequence":
        # what lies outside the blocks bounds the edit distance, which the JVM tells first
        n = F.length("a"), F.length("b")
        met = met.where(F.levenshtein("a", "b") <= _edits(measure, threshold, F.least(*n), F.greatest(*n)))
        # blocks may differ with the order of the names: the better order counts
        found = F.greatest(found, ratio(measure, F.col("b"), F.col("a")))
    return met.withColumn("similarity", found).where(F.col("similarity") >= threshold)


def least_common(measure: str, threshold: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Characters that names of these lengths have in common, in order, if they reach the threshold."""
    return threshold * ((a + b) / 2 if measure == "sequence" else np.maximum(a, b)) - 1e-6


def _candidates(measure: str, threshold: float, block: list[str], rows: pa.Table) -> pa.Table:
    """Pairs of names of two parts, or of one with itself, that the bounds leave."""
    rows = rows.combine_chunks()
    part, names = rows.column("_part").to_numpy(), rows.column("_name").to_pylist()
    own = rows.column("_low")[0].as_py() == rows.column("_high")[0].as_py()
    sides = [_Signs([n for n, p in zip(names, part) if p == rows.column(c)[0].as_py()]) for c in ("_low", "_high")]
    x, y = [], []
    for i, j in sides[0].alike(sides[1], measure, threshold, own):
        x += [sides[0].names[k] for k in i.tolist()]
        y += [sides[1].names[k] for k in j.tolist()]
    same = [pa.array([rows.column(c)[0].as_py()] * len(x), rows.schema.field(c).type) for c in block]
    return pa.table([*same, pa.array(x, pa.string()), pa.array(y, pa.string())], names=[*block, "_x", "_y"])


class _Signs:
    """Names by length, and the signs of each, a character's number modulo SIGNS."""

    def __init__(self, names: list[str]):
        self.names = sorted(dict.fromkeys(names), key=lambda n: (len(n), n))
        self.n = np.array([len(n) for n in self.names], np.int64)
        self.flat = np.frombuffer("".join(self.names).encode("utf-32-le", "surrogatepass"), "<u4") % SIGNS
        self.start = np.cumsum(self.n) - self.n
        self.counts = np.zeros((len(self.names), SIGNS), np.int64)
        np.add.at(self.counts, (np.repeat(np.arange(len(self.names)), self.n), self.flat), 1)

    def steps(self, rows: slice, most: np.ndarray) -> np.ndarray:
        """A column for each sign and each number of times it may stand in a name, 1 where it does so often; products are common signs."""
        return np.concatenate([self.counts[rows, c : c + 1] > np.arange(m) for c, m in enumerate(most) if m], axis=1).astype(np.float32)

    def alike(self, other: _Signs, measure: str, threshold: float, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(self.names) or not len(other.names):
            return
        most = np.minimum(self.counts.max(0), other.counts.max(0))
        if not most.any():
            return
        for lo in range(0, len(self.names), TILE[0]):
            rows = slice(lo, lo + TILE[0])
            n, steps = self.n[rows], self.steps(rows, most)
            # a common subsequence is no longer than the shorter name
            fits = np.minimum(n[0], other.n) >= least_common(measure, threshold, n[0], other.n)
            fits |= np.minimum(n[-1], other.n) >= least_common(measure, threshold, n[-1], other.n)
            fits |= (other.n >= n[0]) & (other.n <= n[-1])
            first, last = (int(np.argmax(fits)), len(fits) - int(np.argmax(fits[::-1]))) if fits.any() else (0, 0)
            for at in range(max(first, lo) if own else first, last, TILE[1]):
                cols = slice(at, min(at + TILE[1], last))
                common = steps @ other.steps(cols, most).T
                i, j = np.nonzero(common >= least_common(measure, threshold, n[:, None], other.n[None, cols]).astype(np.float32))
                i, j = i + lo, j + at
                if own:
                    i, j = i[i < j], j[i < j]
                for few in range(0, len(i), 200_000):
                    a, b = i[few : few + 200_000], j[few : few + 200_000]
                    kept = self.in_order(a, other, b) >= least_common(measure, threshold, self.n[a], other.n[b])
                    yield a[kept], b[kept]

    def masks(self, rows: np.ndarray) -> np.ndarray:
        """Bit p of [row, sign]: whether the sign stands at place p; names of at most 64 characters."""
        out = np.zeros((len(rows), SIGNS + 1), np.uint64)
        n = self.n[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        sign = self.flat[np.repeat(self.start[rows], n) + place]
        np.bitwise_or.at(out, (owner, sign), np.uint64(1) << place.astype(np.uint64))
        return out

    def in_order(self, a: np.ndarray, other: _Signs, b: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of signs of each pair, bit by bit; of two names beyond 64 characters the bound only."""
        out = np.minimum(self.n[a], other.n[b])
        for one, i, two, j, at in ((self, a, other, b, self.n[a] <= 64), (other, b, self, a, (self.n[a] > 64) & (other.n[b] <= 64))):
            at = np.flatnonzero(at)
            if not len(at):
                continue
            i, j = i[at], j[at]
            held, of = np.unique(i, return_inverse=True)
            masks, n = one.masks(held), two.n[j]
            v = np.full(len(at), ~np.uint64(0))
            for p in range(int(n.max())):
                sign = np.where(p < n, two.flat[np.minimum(two.start[j] + p, len(two.flat) - 1)], SIGNS)
                u = v & masks[of, sign]
                v = (v + u) | (v - u)
            inside = ~np.uint64(0) >> (np.uint64(64) - one.n[i].astype(np.uint64))
            out[at] = np.bitwise_count(~v & inside)
        return out
