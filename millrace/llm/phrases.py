"""Operator 11: phrase collocations by count tries.

Each task builds, for a bounded run of words of one language, a trie of phrases with their counts: first of one and
two words, then of three and four. Its nodes in the order of their paths, each with its depth, word and count, are
the serialised trie. Cut points of the paths, taken from a bounded sample of the stored tries, part all paths into
prefix ranges of about equal bytes; every trie is split at them, and one task merges the sorted runs of a range and
adds up the counts of equal paths. A phrase of three and four words is put into a trie only if its neighbouring pairs
may be frequent, which a bit table of fixed size tells: wrong only by keeping too much.

The merged nodes of at least the least count are a table by path. The left part of a cut is the node's ancestor at
that depth, the right part is where so many suffix links lead; both stand in the same table, as a part is as frequent
as its whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stored

# Fixed values of the phrase rules.
DELIMITERS = b".,;:!?\n\x0b\x0c\r"
DEEPEST = 4
LEAST = 30
SCALE = 2_000_000
COVERED = (80, 100)
FIRST = 2000

#: Words of one trie at most, nodes of one stored block, bytes of one merged range, sampled cut points at most.
SHARD_WORDS = 500_000
BLOCK_NODES = 1 << 17
RANGE_BYTES = 6 << 20
SAMPLE = 20_000
#: One path of so many is marked.
MARKED = 2048
#: Bits of the table of pairs that may be frequent: 16 MB at any size of input.
FILTER_BITS = 27
#: Bytes of a text that are split into words at a time.
PART_BYTES = 4 << 20
BREAK = b"\xff"  # no byte of UTF-8
WORD, END = re.compile(rb"\xff|[^\x20\x09\xff]+"), re.compile(rb"[\x20\x09\xff]")

_MAP = bytearray(range(256))
for _c in range(ord("A"), ord("Z") + 1):
    _MAP[_c] = _c + 32
for _c in DELIMITERS:
    _MAP[_c] = 0xFF
_MAP = bytes(_MAP)

#: A block of a trie: words of the whole trie (in its first block), bytes of its nodes and words, the first two words
#: of evenly spaced paths (parted by a space), its words and its nodes packed.
TRIE = "lang string, words long, size long, marks array<string>, vocab binary, nodes binary"
RUN = pa.schema([("lang", pa.string()), ("words", pa.int64()), ("size", pa.int64()), ("marks", pa.list_(pa.string())), ("vocab", pa.binary()), ("nodes", pa.binary())])


def parts(text: str, most: int = PART_BYTES) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The words of a text in order, with a BREAK between pieces, in parts of bounded size.

    Beside each part stand the words behind it that phrases starting inside it may reach; a cut between pieces needs none.
    """
    data = text.encode("utf-8", "surrogatepass").translate(_MAP)
    at = 0
    while len(data) - at > most:
        end, ahead = data.rfind(BREAK, at + 1, at + most), []
        if end < 0:
            end = max(data.rfind(c, at + 1, at + most) for c in (b" ", b"\t"))
            if end < 0:  # one word longer than a part
                behind = END.search(data, at + most)
                end = behind.start() if behind else len(data)
            for m in WORD.finditer(data, end):
                if m.group() == BREAK or len(ahead) == DEEPEST - 1:
                    break
                ahead.append(m.group())
        yield data[at:end].replace(BREAK, b" \xff ").split(), ahead
        at = end
    yield data[at:].replace(BREAK, b" \xff ").split(), []


def pair_slots(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places in the bit table of pairs of words given by their hashes."""
    import xxhash

    mixed = (first ^ np.uint64(xxhash.xxh3_64_intdigest(lang))) * np.uint64(0x9E3779B97F4A7C15) + second
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - FILTER_BITS)


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts; a stable sort of sorted runs is their merge."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if n is None:
        keys = np.sort(keys)
        n = np.ones(len(keys), np.int64)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[edge], np.add.reduceat(n, edge)


class Trie:
    """A serialised trie: nodes in the order of their paths, as depth, word (place in a sorted vocabulary) and count.

    A node that only leads to others has count 0.
    """

    def __init__(self, vocab: list[bytes], depth: np.ndarray, word: np.ndarray, n: np.ndarray):
        self.vocab, self.depth, self.word, self.n = vocab, depth, word, n

    @classmethod
    def of_paths(cls, vocab: list[bytes], paths: np.ndarray, n: np.ndarray) -> Trie:
        """paths: one row for each counted node, words by their place plus 1, 0 behind the end; in order."""
        rows, deepest = paths.shape
        own = (paths > 0).sum(1)
        fresh = np.ones((rows, deepest), bool)  # whether the path's node at a depth is another than the path's before
        fresh[1:] = np.cumsum(paths[1:] != paths[:-1], axis=1) > 0
        fresh &= paths > 0
        at, depth = np.nonzero(fresh)
        used, word = np.unique(paths[at, depth] - 1, return_inverse=True)
        return cls([vocab[i] for i in used], (depth + 1).astype(np.int8), word.astype(np.int32), np.where(depth + 1 == own[at], n[at], 0))

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """The counted nodes' paths and counts."""
        deepest = int(self.depth.max(initial=1))
        out = np.zeros((len(self.depth), deepest), np.int64)
        for d in range(1, deepest + 1):
            last = np.maximum.accumulate(np.where(self.depth == d, np.arange(len(self.depth)), 0))
            out[:, d - 1] = np.where(self.depth >= d, self.word[last] + 1, 0)
        own = self.n > 0
        return out[own], self.n[own]

    def split(self, cuts: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, Trie]]:
        """(range, trie) of its paths between neighbouring cuts; a path is at or behind a cut by its first two words."""
        paths, n = self.paths()
        two = paths[:, 0] * (len(self.vocab) + 1) + (paths[:, 1] if paths.shape[1] > 1 else 0)
        name = lambda i: (self.vocab[paths[i, 0] - 1], self.vocab[paths[i, 1] - 1] if paths.shape[1] > 1 and paths[i, 1] else b"")
        first, last = bisect_right(cuts, name(0)), bisect_right(cuts, name(len(n) - 1))
        at = 0
        for r in range(first, last + 1):
            if r < last:
                a, b = (bisect_left(self.vocab, w) for w in cuts[r])
                same = a < len(self.vocab) and self.vocab[a] == cuts[r][0]
                # the least path at or behind the cut, by the words that the vocabulary has
                until = int(np.searchsorted(two, (a + 1) * (len(self.vocab) + 1) + (b + 1 if same and cuts[r][1] else 0)))
            else:
                until = len(n)
            if until > at:
                yield r, Trie.of_paths(self.vocab, paths[at:until], n[at:until])
            at = until

    def row(self, lang: str, words: int) -> dict:
        paths, _ = self.paths()
        marks = [b" ".join(self.vocab[i - 1] for i in p if i).decode("utf-8", "surrogatepass") for p in paths[MARKED // 2 :: MARKED, :2].tolist()]
        vocab = b"\n".join(self.vocab)  # no word has a line end
        nodes = self.depth.tobytes() + self.word.tobytes() + self.n.astype(np.int64).tobytes()
        pack = zstandard.ZstdCompressor(1).compress
        return {"lang": lang, "words": words, "size": len(nodes) + len(vocab), "marks": marks, "vocab": pack(vocab), "nodes": pack(nodes)}

    @classmethod
    def of_row(cls, vocab: bytes, nodes: bytes) -> Trie:
        unpack = zstandard.ZstdDecompressor().decompress
        data = unpack(nodes)
        k = len(data) // 13
        return cls(unpack(vocab).split(b"\n"), np.frombuffer(data, np.int8, k), np.frombuffer(data, np.int32, k, k), np.frombuffer(data, np.int64, k, 5 * k))


class Shard:
    """Words of one language gathered until their trie is built."""

    def __init__(self):
        self.ids: dict[bytes, int] = {BREAK: 0}
        self.runs: list[np.ndarray] = []
        self.ahead: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes], ahead: list[bytes]) -> None:
        """Words in order, and those behind them that only end phrases."""
        ids = self.ids
        for w in set(words).union(ahead).difference(ids):
            ids[w] = len(ids)
        n = len(words) + len(ahead)
        self.runs += [np.fromiter(map(ids.__getitem__, words + ahead), np.int32, n), np.zeros(1, np.int32)]
        self.ahead.append(np.arange(self.size + len(words), self.size + n))
        self.size += n + 1

    def built(self, lang: str, depths: tuple[int, int], frequent: np.ndarray | None) -> tuple[Iterator[Trie], int]:
        """The trie of phrases between two depths, in blocks in the order of their paths, and the number of words."""
        vocab = sorted(w for w in self.ids if w != BREAK)
        place = np.zeros(len(self.ids), np.int64)
        place[[self.ids[w] for w in vocab]] = np.arange(1, len(vocab) + 1)
        at = place[np.concatenate(self.runs)]
        width = len(vocab) + 1
        own = at > 0
        own[np.concatenate(self.ahead)] = False
        starts = np.flatnonzero(own)
        good = None
        if frequent is not None:
            pair, _ = counted((at[:-1] * width + at[1:])[(at[:-1] > 0) & (at[1:] > 0)])
            hashes = np.r_[np.uint64(0), word_hashes(vocab)]
            slot = pair_slots(lang, hashes[pair // width], hashes[pair % width])
            kept = pair[(frequent[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            good = np.zeros(len(at), bool)
            if len(kept):
                pairs = at[:-1] * width + at[1:]
                near = np.minimum(np.searchsorted(kept, pairs), len(kept) - 1)
                good[:-1] = (kept[near] == pairs) & (at[:-1] > 0) & (at[1:] > 0)
        levels = []  # of each depth: paths and counts
        paths = np.arange(1, width, dtype=np.int64)[:, None]
        keys = at[starts] - 1  # a phrase's place among the distinct ones of its depth
        for depth in range(1, depths[1] + 1):
            if depth > 1:
                ends = starts + depth - 1
                inside = ends < len(at)
                inside[inside] = at[ends[inside]] > 0
                if good is not None:
                    inside[inside] = good[ends[inside] - 1]
                starts, keys = starts[inside], keys[inside]
                longer = keys * width + at[starts + depth - 1]
                distinct, keys = np.unique(longer, return_inverse=True)
                paths = np.c_[paths[distinct // width], distinct % width]
            if depth >= depths[0]:
                n = np.bincount(keys, minlength=len(paths)).astype(np.int64)
                levels.append((np.pad(paths, ((0, 0), (0, depths[1] - depth))), n))
        paths, n = np.concatenate([p for p, _ in levels]), np.concatenate([n for _, n in levels])
        paths, n = paths[n > 0], n[n > 0]
        order = np.lexsort(paths.T[::-1])
        blocks = (order[i : i + BLOCK_NODES] for i in range(0, len(order), BLOCK_NODES))
        return (Trie.of_paths(vocab, paths[b], n[b]) for b in blocks), int(own.sum())


def tries(docs: DataFrame, depths: tuple[int, int], frequent=None) -> DataFrame:
    """Serialised tries of bounded runs of words, in blocks; words: those of the trie, in its first block alone."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if frequent is None else np.frombuffer(frequent.value, np.uint8)
        shards: dict[str, Shard] = {}

        def finish(lang: str) -> Iterator[pa.RecordBatch]:
            shard = shards.pop(lang)
            blocks, words = shard.built(lang, depths, table)
            for block in blocks:
                yield pa.RecordBatch.from_pylist([block.row(lang, words)], schema=RUN)
                words = 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for words, ahead in parts(text.as_py() or ""):
                    shard = shards.setdefault(lang, Shard())
                    shard.add(words, ahead)
                    if sum(s.size for s in shards.values()) >= 2 * SHARD_WORDS or shard.size >= SHARD_WORDS:
                        yield from finish(max(shards, key=lambda x: shards[x].size))
        for lang in list(shards):
            yield from finish(lang)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(build, TRIE)


def cut_points(runs: DataFrame) -> dict[str, list[tuple[bytes, bytes]]]:
    """Of each language, the first two words at which its paths are cut into ranges of about equal bytes.

    Taken from at most SAMPLE marked paths; they decide only which task merges what.
    """
    sizes = {r["lang"]: r["size"] for r in runs.groupBy("lang").agg(F.sum("size").alias("size")).orderBy(F.desc("size")).limit(SAMPLE).collect()}
    marks = runs.select("lang", "size", F.posexplode("marks").alias("at", "mark"))
    found: dict[str, list[tuple[bytes, bytes]]] = {}
    for r in marks.orderBy(F.xxhash64("lang", "mark", "size", "at")).limit(SAMPLE).select("lang", "mark").collect():
        first, _, second = r["mark"].encode("utf-8", "surrogatepass").partition(b" ")
        found.setdefault(r["lang"], []).append((first, second))
    out = {}
    for lang, names in found.items():
        names.sort()
        ranges = min(len(names), sizes.get(lang, 0) // RANGE_BYTES + 1)
        out[lang] = sorted({names[i * len(names) // ranges] for i in range(1, ranges)})
    return out


def merged(runs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n_words, f, slot) of the phrases with at least so many occurrences; slot: a pair's place in the bit table."""
    cuts = cut_points(runs)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang = batch.column(0)[i].as_py()
                out = []
                for r, trie in Trie.of_row(batch.column(1)[i].as_py(), batch.column(2)[i].as_py()).split(cuts.get(lang, [])):
                    out.append({"range": r} | trie.row(lang, 0))
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("range", pa.int32()), *RUN]))

    def merge(rows: pa.Table) -> pa.Table:
        lang = rows.column("lang")[0].as_py()
        cells = list(zip(rows.column("vocab"), rows.column("nodes")))
        found: set[bytes] = set()
        for v, _ in cells:  # one cell's words at a time, so that equal words are held once
            found.update(zstandard.ZstdDecompressor().decompress(v.as_py()).split(b"\n"))
        vocab = sorted(found)
        place = {w: i for i, w in enumerate(vocab, 1)}
        runs_, counts = [], []
        for v, packed in cells:
            t = Trie.of_row(v.as_py(), packed.as_py())
            paths, n = t.paths()
            own = np.r_[0, np.fromiter(map(place.__getitem__, t.vocab), np.int64, len(t.vocab))].astype(np.int32)
            runs_.append(own[paths])
            counts.append(n)
        deepest, width = max(p.shape[1] for p in runs_), len(vocab) + 1
        paths, n = np.zeros((sum(map(len, counts)), deepest), np.int32), np.concatenate(counts)
        at = 0
        for p in runs_:
            paths[at : at + len(p), : p.shape[1]] = p
            at += len(p)
        runs_.clear()
        key = paths[:, 0].astype(np.int64)
        for d in range(1, deepest):
            key = key * width + paths[:, d]
            if d < deepest - 1:
                key = np.unique(key, return_inverse=True)[1]  # dense numbers of the prefixes
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0])
        total = np.add.reduceat(n[order], edge)
        kept = total >= least
        paths, total = paths[order[edge[kept]]], total[kept]
        words = (paths > 0).sum(1)
        phrases = [b" ".join(vocab[i - 1] for i in p if i).decode("utf-8", "surrogatepass") for p in paths.tolist()]
        hashes = np.zeros(len(vocab) + 1, np.uint64)
        used = np.unique(paths[paths > 0])
        hashes[used] = word_hashes([vocab[i - 1] for i in used])
        slot = pair_slots(lang, hashes[paths[:, 0]], hashes[paths[:, 1] if deepest > 1 else 0 * paths[:, 0]]).astype(np.int64)
        return pa.table({"lang": pa.array([lang] * len(total), pa.string()), "phrase": pa.array(phrases, pa.string()), "n_words": pa.array(words, pa.int32()), "f": pa.array(total, pa.int64()), "slot": pa.array(slot)})

    dealt = runs.select("lang", "vocab", "nodes").mapInArrow(part, "range int, " + TRIE).drop("words", "size", "marks")
    return dealt.groupBy("lang", "range").applyInArrow(merge, "lang string, phrase string, n_words int, f long, slot long")


def bit_table(pairs: DataFrame) -> bytes:
    """The table of FILTER_BITS bits with those of the column slot set."""
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    parts = pairs.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    for r in parts.collect():  # at most 2 ** FILTER_BITS bits together
        held = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits = np.unpackbits(held, bitorder="little")
        at = np.flatnonzero(bits).astype(np.int64)
        # bucket b holds the slots 32768 (b - 1) + 1 and up to 32768 b; bucket 0 holds slot 0 and below
        slots = at + (r["bucket"] - 1) * 32768 + 1 if r["bucket"] > 0 else -at
        np.bitwise_or.at(out, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return out.tobytes()


def wide(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, f) of all phrases of up to four words with at least so many occurrences; (lang, n) of all words."""
    spark = docs.sparkSession
    short = stored(tries(docs, (1, 2)), "tries")
    totals = short.groupBy("lang").agg(F.sum("words").alias("n"))
    few = stored(merged(short, least), "phrases")
    frequent = spark.sparkContext.broadcast(bit_table(few.where("n_words = 2")))
    longer = stored(tries(docs, (3, DEEPEST), frequent), "tries")
    return stored(few.unionByName(merged(longer, least)).drop("slot"), "phrases"), totals


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language, at most `first` of them.

    Null texts are empty, a null lang is `und`; repeated rows count each; texts without words give nothing, an empty
    table gives no rows; other columns are ignored. Ties of score and count go by the phrase's UTF-8 bytes. Words
    are whatever stands between spaces, tabs and delimiters, of any length. All counts are exact.
    """
    counts, totals = phrase_counts(docs, least)
    words = F.split("phrase", " ")
    join = lambda w: F.array_join(w, " ")
    longer = counts.where("n_words > 1")
    cut = longer.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", join(F.slice("w", F.lit(1), F.col("k"))).alias("left"), join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("right"))
    ancestor = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("left"), F.col("f").alias("l"))
    suffix = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("right"), F.col("f").alias("r"))
    cut = cut.join(ancestor, (F.col("lang") == F.col("_lang")) & (cut["left"] == ancestor["left"])).select("lang", "phrase", "a", "k", "right", "l")
    cut = cut.join(suffix, (F.col("lang") == F.col("_lang")) & (cut["right"] == suffix["right"])).select("lang", "phrase", "a", "k", "l", "r")
    # decimals: the product may pass 64 bits; numerator and denominator are positive, so the quotient's floor is exact
    top, below = wide(F.col("a")) * F.lit(SCALE).cast("decimal(8,0)"), wide(F.col("l")) + wide(F.col("r"))
    cut = cut.withColumn("_top", top).withColumn("_below", below).withColumn("score", F.expr("cast(_top div _below as long)"))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    # the phrases that a longer one covers
    part = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: join(F.slice("w", i, m))))))
    inner = longer.where("n_words > 2").select("lang", F.col("f").alias("longer"), words.alias("w")).select("lang", "longer", part.alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    least_share, of = COVERED
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide(F.col("longer")) * of < wide(F.col("a")) * least_share))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    """The best phrases of each language in all documents; see collocations()."""
    return collocations(documents(spark, sf_dir))


#: The same by plain counting, for DuckDB.
ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang
), grams AS (
  SELECT lang, m, w[i:i + m - 1] AS p FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, range(1, 5) AS r(m) WHERE len(w) >= m)
), counted AS (
  SELECT lang, m, p, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), cut AS (
  SELECT lang, p, f AS a, k, p[1:k] AS x, p[k + 1:] AS y, m FROM counted, range(1, 4) AS g(k) WHERE k < m
), cuts AS (
  SELECT c.lang, c.m, c.p, c.a, c.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
  FROM cut c JOIN counted l ON l.lang = c.lang AND l.p = c.x JOIN counted r ON r.lang = c.lang AND r.p = c.y
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS nth FROM cuts
), inner_ AS (
  SELECT lang, p[i:i + s - 1] AS p, max(f) AS longer FROM (
    SELECT lang, p, f, s, unnest(range(1, m - s + 2)) AS i FROM counted, range(2, 4) AS t(s) WHERE s < m) GROUP BY ALL
), kept AS (
  SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.p = b.p
  WHERE nth = 1 AND (i.longer IS NULL OR 100 * i.longer::HUGEINT < 80 * b.a::HUGEINT)
)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) k
JOIN total t ON t.lang = k.lang WHERE k.rank <= 2000
"""
