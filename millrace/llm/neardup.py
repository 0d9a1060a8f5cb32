"""Operator 7: near duplicates by order MinHash, verified by banded alignment.

A text is the sequence of its k-mers (k words each), every k-mer labelled with how often it came before. For each of
`bands` hash functions the `several` labelled k-mers of least hash, in the order of the text, are one signature;
equal signatures make candidates. Texts with the same k-mers in another order thus rarely meet. Equal texts are one
representative from the start.

A candidate is verified by words: with L the longest common subsequence of two texts of n and m words, their
similarity is L / (n + m - L), at least `threshold`. That bound limits how far apart aligned words can stand, and
only that band is aligned. k-mers only find the candidates, as one changed word spoils k of them.

A bucket of equal signatures links each member to its first and last member by hash, in every band; large
buckets are parted by the next band's signature and linked once more inside the parts. That compares all of a bucket
up to three members. Larger ones whose members do not end in one component are resolved exactly: of their texts,
pairs of different components that share one of their rarest k-mers (as many as a k-mer similarity of `threshold`
asks for) are compared, first with two heads for each k-mer, then all that is left. So texts of one bucket of whose
k-mers the threshold is kept in order always share a class; pairs below that, but similar by words, are found by
heads and bands (the share found is measured in the tests).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, join_hot, own_names, small, stored
from .components import between, components, crossing, headed

#: Members of a bucket above which it is parted again.
LARGE_BUCKET = 8
#: Members up to which two heads compare every pair of a bucket.
COMPARED_BUCKET = 3
#: Bits of a k-mer's slot at most: 2 ** 22 slots are 4 MB in each task.
SLOT_BITS = 22
_CACHED_WORDS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """A word's 64-bit hash, by its text."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < _CACHED_WORDS and len(word) <= 64:
            self[word] = h
        return h


_hashes = WordHash()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words in the text's order."""
    words = (text or "").lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def kmers(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-mers of word hashes; of fewer words the whole is one; of none, none."""
    if not len(h):
        return np.zeros(0, np.uint64)
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def labelled(h: np.ndarray) -> np.ndarray:
    """k-mers told apart by how often each came before."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return h
    starts = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    out = np.empty_like(h)
    out[order] = s + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return out


def signatures(h: np.ndarray, bands: int, several: int) -> np.ndarray:
    """One 64-bit signature for each band."""
    out = np.zeros(bands, np.uint64)
    h = labelled(h)
    n = min(several, len(h))
    for b in range(bands):
        mixed = (h ^ np.uint64((0x2545F4914F6CDD1D * (b + 1)) & 0xFFFFFFFFFFFFFFFF)) * np.uint64((0x9E3779B97F4A7C15 + 0xBF58476D1CE4E5B8 * (b + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
        mixed ^= mixed >> np.uint64(32)
        least = np.sort(np.argpartition(mixed, n - 1)[:n]) if n < len(h) else np.arange(n)
        sign = b + 1
        for x in h[least].tolist():
            sign = (sign ^ x) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
            sign ^= sign >> 31
        out[b] = sign
    return out


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """L / (n + m - L) if that can reach the threshold, else 0. L: longest common subsequence inside the band.

    The similarity asks for L >= t (n + m) / (1 + t), so at most n + m - 2 L words stand unaligned and no aligned
    pair is further apart. Bits of one integer are the places of b (Hyyro's recurrence); places outside the band of
    the row are masked.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    need = threshold * (n + m) / (1 + threshold)
    if min(n, m) < need - 1e-9:
        return 0.0
    low = min(n, m)
    differs = np.flatnonzero(a[:low] != b[:low])
    head = int(differs[0]) if len(differs) else low
    tail = 0
    rest = low - head
    if rest:
        differs = np.flatnonzero(a[::-1][:rest] != b[::-1][:rest])
        tail = int(differs[0]) if len(differs) else rest
    x, y = a[head : n - tail], b[head : m - tail]
    if len(x) and len(y):
        common = np.intersect1d(labelled(x.astype(np.uint64)), labelled(y.astype(np.uint64)), assume_unique=True)
        if head + tail + len(common) < need - 1e-9:
            return 0.0
    band = int(n + m - 2 * need + 1e-9) + abs(n - m)
    length = head + tail
    if len(x) and len(y):
        places: dict[int, int] = {}
        for j, v in enumerate(y.tolist()):
            places[v] = places.get(v, 0) | 1 << j
        full = free = (1 << len(y)) - 1
        window = (1 << (2 * band + 1)) - 1
        for i, v in enumerate(x.tolist()):
            if match := places.get(v, 0):
                match &= window << (i - band) if i >= band else window >> (band - i)
                u = free & match
                free = ((free + u) | (free - u)) & full
        length += len(y) - free.bit_count()
    similarity = length / (n + m - length)
    return similarity if similarity >= threshold - 1e-12 else 0.0


def sketches(docs: DataFrame, k: int, bands: int, several: int) -> DataFrame:
    """doc_id, h (64-bit hash of the text), n (words), keys (signatures), words (their 32-bit hashes as bytes) of each row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, words = [], [], []
            for text in batch.column(2):
                h = word_hashes(text.as_py()) >> np.uint64(32)
                sizes.append(len(h))
                keys.append(signatures(kmers(h, k), bands, several).view(np.int64).tolist() if len(h) else [])
                words.append(h.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.binary())], names=["doc_id", "h", "n", "keys", "words"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(sketch, "doc_id long, h long, n long, keys array<long>, words binary")


def fitting(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of rows h, n, r (h, n): lengths further apart than the threshold lets be can't be similar."""
    pairs = pairs.where(F.least("n", F.col("r.n")) >= (threshold - 1e-9) * F.greatest("n", F.col("r.n")))
    return pairs.select(F.least("h", F.col("r.h")).alias("a"), F.greatest("h", F.col("r.h")).alias("b"))


def candidates(texts: DataFrame, bands: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of texts (h, n, keys) with a signature in common, in proportion to the signatures.

    Also the members (g, h, n) of the buckets g too large for two heads to compare every pair.
    """
    shifted = F.concat(F.slice("keys", 2, bands), F.slice("keys", 1, 1))
    rows = texts.where("n > 0").select("h", "n", F.explode(F.arrays_zip(F.col("keys").alias("key"), shifted.alias("next"))).alias("_k")).select("h", "n", "_k.key", "_k.next")

    def starred(members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        # h is a hash, so its order is as good as any; as it is the same in all buckets, copies meet the same few heads
        chosen = F.struct("h", "n")
        heads = members.groupBy("key").agg(F.min(chosen).alias("r1"), F.max(chosen).alias("r2"), F.count(F.lit(1)).alias("many")).where("many > 1")
        joined = members.join(stored(heads.select("key", "many", F.array("r1", "r2").alias("rs")), name), "key")
        return fitting(joined.select("h", "n", F.explode("rs").alias("r")).where(F.col("h") != F.col("r.h")), threshold), joined

    pairs, joined = starred(rows, "heads")
    crowded = stored(joined.where(F.col("many") > COMPARED_BUCKET).select("key", "next", "h", "n", "many"), "crowded")
    parted, _ = starred(crowded.where(F.col("many") > LARGE_BUCKET).select("h", "n", F.xxhash64("key", "next").alias("key")), "parted")
    return stored(pairs.unionByName(parted).distinct(), "pairs"), crowded.select(F.col("key").alias("g"), "h", "n")


def rarest(texts: DataFrame, sketched: DataFrame, k: int, threshold: float) -> DataFrame:
    """(g, h, n, p): the rarest labelled k-mers g of texts (h), so many that two texts that keep the threshold of them share one.

    Such texts of n and m >= threshold n k-mers have threshold n of them in common at least, so in one order of all
    k-mers they share one of the first n - ceil(threshold n) + 1. That holds for any order; this one is by how often
    the k-mer's slot is met (its slot: the first bits of its hash; counts over all of these texts, in at most
    2 ** SLOT_BITS slots), then by the k-mer. A k-mer alone in its slot meets nobody and is left out.
    n: the text's k-mers; p: the k-mer's place in that order, from 1.
    """
    words = sketched.select("h", "words").join(texts, "h", "left_semi").groupBy("h").agg(F.first("words").alias("words"))
    words = stored(words, "crowded_words")
    total = words.agg(F.sum(F.length("words") / 4)).first()[0] or 1
    bits = min(SLOT_BITS, max(16, math.ceil(math.log2(4 * total))))

    def of_text(words: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        e = labelled(kmers(np.frombuffer(words.as_py(), np.uint32).astype(np.uint64), k))
        return e, ((e * _MIX) >> np.uint64(64 - bits)).astype(np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [np.zeros(0, np.int32)], 0

        def rows() -> pa.RecordBatch:
            slot, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], names=["slot", "n"])

        for batch in batches:
            for text in batch.column(0):
                kept.append(of_text(text)[1])
                size += len(kept[-1])
                if size >= 1 << 20:
                    yield rows()
                    kept, size = [], 0
        if kept:
            yield rows()

    met = words.select("words").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    met = met.select("slot", F.least(F.lit(255), 1 + F.floor(8 * F.log2("n"))).cast("short").alias("level")).toArrow()  # at most a row a slot
    levels = np.zeros(1 << bits, np.uint8)
    levels[met["slot"].to_numpy()] = met["level"].to_numpy()
    shared = words.sparkSession.sparkContext.broadcast(levels)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.int64),) * 4]
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                e, slot = of_text(text)
                n, level = len(e), shared.value[slot]
                order = np.lexsort((e, level))[: n - math.ceil(threshold * n - 1e-6) + 1]
                place = np.flatnonzero(level[order])
                found.append((e[order[place]].view(np.int64), np.full(len(place), h), np.full(len(place), n), place + 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names=["g", "h", "n", "p"])

    return words.mapInArrow(elements, "g long, h long, n long, p long")


def early(threshold: float) -> Column:
    """The first k-mer that two texts share leaves n - p + 1 at most in common, so it has to stand early enough in both."""
    need = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("r.n")) - 1e-6
    return (F.col("n") - F.col("p") + 1 >= need) & (F.col("r.n") - F.col("r.p") + 1 >= need)


def links_of(texts: DataFrame, sketched: DataFrame, k: int, bands: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, similarity) and the components (node, root) that they make; see the head of this file."""
    pairs, crowded = candidates(texts, bands, threshold)
    links = stored(verified(pairs, sketched, threshold), "links")
    roots = stored(components(links), "roots")
    left = stored(crossing(crowded, roots).select("h").distinct(), "left")
    if not left.limit(1).count():
        return links, roots
    members = stored(rarest(left, sketched, k, threshold), "rarest")
    tried = pairs
    for pick in (headed, between):
        met = pick(stored(crossing(members, roots), "crossing"), "n", "p").where(early(threshold))
        chosen = fitting(met, threshold).distinct()
        rest = stored(chosen.join(tried, ["a", "b"], "left_anti"), "rest")
        more = stored(verified(rest, sketched, threshold), "more")
        if more.limit(1).count():
            links, tried = stored(links.unionByName(more), "links"), stored(tried.unionByName(rest), "tried")
            roots = stored(components(links), "roots")
    return links, roots


def verified(pairs: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold by alignment of their words."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            likeness = [aligned(np.frombuffer(p.as_py(), np.uint32), np.frombuffer(q.as_py(), np.uint32), threshold) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(likeness, pa.float64())], names=["a", "b", "similarity"])

    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "needed")
    words = sketched.select("h", "words").join(small(needed, needed.count(), 2_000_000), "h", "left_semi")
    words = stored(words.groupBy("h").agg(F.first("words").alias("words")), "words")
    known = join_hot(pairs, "a", words.withColumnRenamed("words", "x"), ["b"])
    known = join_hot(known, "b", words.withColumnRenamed("words", "y"), ["a"])
    return known.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, similarity double").where("similarity > 0")


def classified(docs: DataFrame, k: int, threshold: float, bands: int, several: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of docs (doc_id, h, ...), and for each text h its class: class_id, first (text that stands for the class), links, copies."""
    sketched = stored(sketches(docs, k, bands, several), "sketches")
    texts = stored(sketched.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")), "texts")
    links, roots = links_of(texts, sketched, k, bands, threshold)
    counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    linked = stored(texts.select("h", "rep").join(roots, F.col("h") == F.col("node")).select("h", "root", "rep"), "linked")
    # of texts with one least id the least hash stands for the class; a null id only among nulls
    least = linked.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "h")).alias("f"))
    least = least.select(F.col("root").alias("h"), F.col("f.rep").alias("class_id"), F.col("f.h").alias("first"))
    linked = join_hot(linked.select(F.col("h").alias("text"), "root"), "root", least, ["text"])
    linked = linked.join(counts, F.col("text") == F.col("node")).select(F.col("text").alias("h"), "class_id", "first", "links")
    classes = texts.select("h", "rep", "copies").join(linked, "h", "left")
    classes = classes.select(
        "h", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("first", "h").alias("first"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"), "copies",
    )
    return sketched, stored(classes, "classes")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, bands: int = 20, several: int = 3) -> DataFrame:
    """doc_id, class_id, links, copies for each row of docs.

    class_id is the least doc_id of the class: rows joined by equal texts (64-bit hash) or by links of similarity >=
    threshold. links: verified links of the row's text to other texts; copies: rows with the same text. A null text
    equals only other nulls; texts without words link with nothing. Repeated rows are copies of one another. A null
    doc_id is the class_id only where all ids of the class are null. Empty tables give no rows. Other columns are
    ignored.
    """
    sketched, classes = classified(docs, k, threshold, bands, several)
    rows = sketched.select("doc_id", F.col("h").alias("text"))
    return join_hot(rows, "text", classes, ["doc_id"]).select("doc_id", "class_id", "links", "copies")


def one_of_each(docs: DataFrame, k: int = 5, threshold: float = 0.8, bands: int = 20, several: int = 3) -> DataFrame:
    """docs without the near duplicates: of each class one row of the least doc_id stays.

    All columns stay as they are, whatever their names. A null doc_id is kept only in a class of null ids. Where the
    least id (or null) has several texts in the class, the text of least hash stays; classes that share an id keep a
    row each; of equal rows one stays. Null texts are one class, empty ones another. Empty tables give no rows.
    """
    sketched, classes = classified(docs, k, threshold, bands, several)
    firsts = classes.where(F.col("h") == F.col("first")).select(F.col("h").alias("_h"), F.col("class_id").alias("_id"))
    firsts = sketched.select("doc_id", "h").join(firsts, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    h, own, many = own_names(docs.columns, "_h", "_id", "_many")
    firsts = stored(firsts.groupBy("_h", "_id").agg(F.count(F.lit(1)).alias("_many")), "firsts").toDF(h, own, many)
    kept = docs.join(firsts, (F.xxhash64("text") == F.col(h)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own)))
    if not firsts.where(F.col(many) > 1).limit(1).count():
        return kept.select(*docs.columns)
    repeated = kept.where(F.col(many) > 1).groupBy(F.col(h).alias("_h")).agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return kept.where(F.col(many) == 1).select(*docs.columns).unionByName(repeated)


def op7_order_minhash(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document; see near_duplicates()."""
    return near_duplicates(documents(spark, sf_dir))
