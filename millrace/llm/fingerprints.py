"""Operator 3: document fingerprints by randomised edit embedding.

A shared random walk copies a text's characters into a longer sequence: at step j the walk stands on a character and
goes on to the next one or not, as a bit drawn for (j, character) says. Few edits change few places of the embedded
sequence, so edit distance becomes Hamming distance. The fingerprint keeps the characters at the `samples` places of
least hash among the places the walk reaches, four bits each, and how far the walk went; the kept places of a longer
text restricted to a shorter one's reach are a subset of the shorter one's, so any two fingerprints compare.
Rare symbols at their places find candidates, the likeness of whole fingerprints verifies them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stored

SAMPLES = 256
#: Steps after which the walk's random bits repeat.
PERIOD = 4096
#: Chance that two unlike places show the same symbol, taken off the likeness.
BY_CHANCE = 0.12
#: Code points that are walked together; a longer text is a walk of its own.
WALKED = 12_000_000
#: Fingerprints in a block of those that are all compared.
BLOCK = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _waits() -> np.ndarray:
    """[character class, step]: steps the walk stays on a character of the class that it meets at that step."""
    bits = (_mix(np.arange(256 * PERIOD, dtype=np.uint64)) & np.uint64(1)).astype(bool).reshape(256, PERIOD)
    bits[:, -1] = True  # no wait is longer than a period
    out = np.zeros((256, PERIOD), np.int32)
    left = np.zeros(256, np.int32)
    for _ in range(2):
        for j in range(PERIOD - 1, -1, -1):
            left = np.where(bits[:, j], 1, left + 1)
            out[:, j] = left
    return out.reshape(-1)


class Walker:
    """The walk's table and the order of sampled places, made once a worker."""

    def __init__(self) -> None:
        self.waits = _waits()
        self.places: dict[int, np.ndarray] = {}

    def sampled(self, reach: int) -> np.ndarray:
        """The SAMPLES places of least hash among [0, reach), by hash."""
        power = max(10, int(reach).bit_length())
        if power not in self.places:
            # a superset for every reach of this bit length: the places below the hash that keeps 4 SAMPLES of the least reach
            places = np.arange(1 << power, dtype=np.uint64)
            h = _mix(places + np.uint64(1 << 40))
            share = min(1.0, 4 * SAMPLES / max(1, 1 << (power - 1)))
            keep = np.flatnonzero(h <= np.uint64(min(2**64 - 1, int(share * 2.0**64))))
            self.places[power] = keep[np.argsort(h[keep], kind="stable")]
        near = self.places[power]
        found = near[near < reach][:SAMPLES]
        return found

    def walk(self, texts: list[str]) -> list[str]:
        """Fingerprints of the texts, all walked side by side, character by character."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        longest = int(lengths[0]) if len(lengths) else 0
        # active[i]: texts that have a character i; start[i]: where those characters stand, one after another
        active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest), "right")
        start = np.concatenate([[0], np.cumsum(active)])
        chars = np.zeros(int(start[-1]), np.uint8)
        for rank, i in enumerate(order):
            points = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32)
            chars[start[: len(points)] + rank] = (points * np.uint32(0x9E3779B1)) >> np.uint32(24)
        arrival = np.zeros(len(chars), np.int32)
        step = np.zeros(len(order), np.int32)
        where, waits = chars.astype(np.int32) * PERIOD, self.waits
        bounds, many = start.tolist(), active.tolist()
        for i in range(longest):
            k, lo = many[i], bounds[i]
            at = step[:k]
            arrival[lo : lo + k] = at
            at += waits[where[lo : lo + k] + (at & (PERIOD - 1))]
        out = [""] * len(texts)
        for rank, i in enumerate(order):
            mine = start[: lengths[rank]] + rank
            reach = int(step[rank])
            places = self.sampled(reach)
            char = chars[mine[np.searchsorted(arrival[mine], places, "right") - 1]] if reach else np.zeros(0, np.uint8)
            symbols = (_mix(char.astype(np.uint64) * np.uint64(1 << 32) + places.astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
            out[i] = f"{reach:x}:" + symbols.tobytes().hex()[1::2]
        return out


_walker: list[Walker] = []


def walker() -> Walker:
    if not _walker:
        _walker.append(Walker())
    return _walker[0]


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of any number of texts, WALKED code points at a time."""
    out, part, size = [], [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= WALKED:
            out += walker().walk(part)
            part, size = [], 0
    return out + (walker().walk(part) if part else [])


def likeness(one: str, other: str) -> float:
    """0 to 1: the share of sampled places with the same symbol, less what chance gives. Two empty texts are alike."""
    (r1, s1), (r2, s2) = (f.split(":") for f in (one, other))
    r1, r2 = int(r1, 16), int(r2, 16)
    if r1 > r2:
        r1, r2, s1, s2 = r2, r1, s2, s1
    if not r2:
        return 1.0
    long = np.frombuffer(s2.encode(), np.uint8)
    inside = walker().sampled(r2) < r1
    # the longer one's places inside the shorter reach are the shorter one's first ones by hash
    n = int(inside.sum())
    same = int((long[inside] == np.frombuffer(s1.encode(), np.uint8)[:n]).sum()) / len(long)
    return float(min(1.0, max(0.0, (same - BY_CHANCE) / (1 - BY_CHANCE)))) if one != other else 1.0


def edited(text: str, following: str) -> str:
    """The last half of text replaced by as many first code points of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FINGERPRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, rows_per_cell: int = 400) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; see FINGERPRINTED.

    Documents follow each other by doc_id (nulls first, equal ids by the text's hash); after the last comes the
    first, and a single row follows itself. A null text is empty. An empty table gives no rows. Other columns are
    ignored. Texts are dealt by ranges of ids; the first row of a range also goes to the range before it.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total, low, high = keyed.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    if not total:
        return spark.createDataFrame([], FINGERPRINTED)
    parts = max(1, min(50_000, total // rows_per_cell))
    cuts = [] if low is None or low == high or parts == 1 else keyed.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)
    cuts = sorted({int(c) for c in cuts})
    grid = spark.sparkContext.broadcast(np.array(cuts, np.int64))  # at most 50,000 cuts

    @F.pandas_udf("int")
    def cell_of(ids):
        import pandas as pd

        found = np.searchsorted(grid.value, ids.fillna(-(2**63)).to_numpy(np.int64), "right")
        return pd.Series(np.where(ids.isna(), 0, found).astype(np.int32))

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = keyed.withColumn("cell", cell_of("doc_id"))
    firsts = ranged.groupBy("cell").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("f"))
    rows = sorted((r["cell"], r["f"]["doc_id"]) for r in firsts.collect())  # a row for each cell
    back = [(rows[i][1], rows[i - 1][0]) for i in range(len(rows))]
    halo = spark.createDataFrame([(d, c) for d, c in back], "first_id long, before int")
    ranged = ranged.join(F.broadcast(halo), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    dealt = ranged.select("doc_id", "text", F.explode(F.when(F.col("before").isNotNull(), F.array(F.struct(F.col("cell"), F.lit(0).alias("halo")), F.struct(F.col("before").alias("cell"), F.lit(1).alias("halo")))).otherwise(F.array(F.struct(F.col("cell"), F.lit(0).alias("halo"))))).alias("to"))
    dealt = dealt.select("doc_id", "text", "to.cell", "to.halo")
    dealt = dealt.repartition(max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions")))), "cell").sortWithinPartitions("cell", "halo", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(part: list[tuple]) -> pa.RecordBatch:
            """Rows of part but the last are done: each with the row after it, where that is of its cell."""
            prints = fingerprints([p[1] for p in part])
            out: list[tuple] = []
            pairs = [(i, i + 1) for i in range(len(part) - 1) if not part[i][3] and part[i][2] == part[i + 1][2]]
            changed = [edited(part[i][1], part[j][1]) for i, j in pairs]
            for (i, j), text, printed in zip(pairs, changed, fingerprints(changed)):
                sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((part[i][0], len(part[i][1]), sha, prints[i], printed, likeness(prints[i], printed), likeness(prints[i], prints[j])))
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        part, size = [], 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if row[3] and part and part[-1][3] and part[-1][2] == row[2]:
                    continue  # equal first ids: only the first of them follows
                text = row[1].as_py()
                part.append((row[0], text, row[2], row[3]))
                size += len(text)
                if size >= WALKED and len(part) > 1:
                    yield finish(part)
                    part, size = part[-1:], len(part[-1][1])
        if len(part) > 1:
            yield finish(part)

    return dealt.mapInArrow(run, FINGERPRINTED)


def near_pairs(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, near), a < b: all pairs of distinct fingerprints (id, fingerprint) that are at least so alike.

    A fingerprint is a set of symbols, each with its place in the walk, the same for all reaches. Fingerprints so alike
    share a fixed part of the longer one's set, so they share one of their rarest symbols (as many as that part asks
    for), and only those are joined; crowded symbols are compared in pairs of blocks. Equal fingerprints are one row
    first, that of the least id.
    """
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("id").alias("id")), "distinct")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, printed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reach, symbols = printed.split(":")
                places = walker().sampled(int(reach, 16)).astype(np.int64)
                keys = places * 16 + np.array([int(x, 16) for x in symbols], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.int64()), pa.array(keys), pa.array(np.full(len(keys), len(keys), np.int64))], names=["id", "k", "n"])

    rows = distinct.select(F.col("id").cast("long"), "fingerprint").mapInArrow(placed, "id long, k long, n long")
    often = stored(rows.groupBy("k").agg(F.count(F.lit(1)).alias("often")), "often")
    part = least * (1 - BY_CHANCE) + BY_CHANCE
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "k"))
    first = rows.join(often.where("often > 1"), "k", "left").withColumn("often", F.coalesce("often", F.lit(1))).withColumn("p", place)
    first = first.where((F.col("p") <= F.col("n") - F.ceil(F.lit(part) * F.col("n") - 1e-6) + 1) & (F.col("often") > 1))
    dealt = stored(first.withColumn("blocks", F.ceil(F.col("often") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")), "dealt")
    left = dealt.select("k", F.col("id").alias("l"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = dealt.select("k", F.col("id").alias("r"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i"))
    met = left.join(right, ["k", "i", "j"]).where((F.col("l") != F.col("r")) & ((F.col("i") < F.col("j")) | (F.col("l") < F.col("r"))))
    pairs = met.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct()
    pairs = pairs.join(distinct.select(F.col("id").alias("a"), F.col("fingerprint").alias("x")), "a").join(distinct.select(F.col("id").alias("b"), F.col("fingerprint").alias("y")), "b")

    @F.pandas_udf("double")
    def near(x, y):
        import pandas as pd

        return pd.Series([likeness(p, q) for p, q in zip(x, y)], dtype=float)

    return pairs.withColumn("near", near("x", "y")).where(F.col("near") >= least).select("a", "b", "near")


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents; see fingerprint_documents()."""
    return fingerprint_documents(documents(spark, sf_dir))
