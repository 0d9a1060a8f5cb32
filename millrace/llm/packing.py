"""Operator 6: packing documents into sequences by a configuration linear program over the length histogram.

Tasks tokenize whole texts and cut what is over the capacity; only piece lengths and checksums go on. The histogram
of lengths (at most `capacity` rows, whatever the input) goes to the driver. There a configuration is a multiset of
lengths that fits one sequence; the program asks for the fewest configurations that cover the histogram. It is
solved by multiplicative weights: a length's price falls as it gets covered, and a knapsack dynamic program finds the
dearest configuration, which is used a whole number of times. The few pieces left when rounds bring little go by best
fit into the room left, in counts of equal sequences. Pieces then learn their sequence from their rank among the
pieces of their length.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, stored

#: Distinct words whose ids a worker keeps; others are tokenized each time they come.
CACHED_WORDS = 100_000
_ALPHA_TAIL = re.compile(rb"([A-Za-z]+)([!-&(-@\[-`{-~][^A-Za-z]*)")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """Ids of a run of non-space characters, as little-endian 32-bit bytes, by the run's UTF-8 bytes.

    The tokenizer drops white space and no token spans it, so a text's ids are its runs' ids in a row. A run of plain
    letters (code points below 256) skips the normalizer and the splitter, which leave it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def __missing__(self, run: bytes) -> bytes:
        if run.isalpha():  # ASCII letters
            found = self.model.tokenize(run.lower().decode())
        elif parts := _ALPHA_TAIL.fullmatch(run):  # letters, then signs: the splitter parts them there, and the parts are kept
            return self[parts[1]] + self[parts[2]]
        else:
            text = run.decode("utf-8", "surrogatepass")
            if text.isalpha() and ord(max(text)) < 256:
                lower = text.lower()
                found = self.model.tokenize(lower if lower.isascii() else lower.translate(self.shown))
            else:
                return self.kept(run, self.whole.encode(text, add_special_tokens=False).ids)
        return self.kept(run, [t.id for t in found])

    def kept(self, run: bytes, found: list[int]) -> bytes:
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(self) < CACHED_WORDS and len(run) <= 64:
            self[run] = ids
        return ids


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def text_ids(words: WordIds, text: str | None) -> bytes:
    return b"".join(map(words.__getitem__, (text or "").encode("utf-8", "surrogatepass").split()))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int, end_id: int, path: str) -> DataFrame:
    """doc_id, piece, start, length and checksum of every piece of every document; a null text is empty."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = text_ids(words, text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES)


def dearest(lengths: np.ndarray, offered: np.ndarray, price: np.ndarray, capacity: int) -> dict[int, int]:
    """Bounded knapsack: the multiset of lengths, each at most as often as offered, of at most capacity in all with the highest price."""
    items = []  # (length, copies): powers of two that add up to what is offered
    for k, (length, n) in enumerate(zip(lengths.tolist(), offered.tolist())):
        part, n = 1, min(n, capacity // length)
        while n > 0:
            items.append((k, min(part, n)))
            n -= part
            part *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), bool)
    for i, (k, copies) in enumerate(items):
        size = int(lengths[k]) * copies
        more = best[: capacity + 1 - size] + price[k] * copies
        np.greater(more, best[size:], out=taken[i, size:])
        best[size:] = np.maximum(best[size:], more)
    out: dict[int, int] = defaultdict(int)
    c = int(best.argmax())
    for i in range(len(items) - 1, -1, -1):
        if taken[i, c]:
            k, copies = items[i]
            out[int(lengths[k])] += copies
            c -= int(lengths[k]) * copies
    return dict(out)


#: Lengths that one round prices: the longest left and as many drawn at random.
PRICED = 40


def program(counts: np.ndarray, capacity: int, rounds: int, rest: float = 0.04, rate: float = 0.2, seed: int = 3) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole uses of configurations that cover no length beyond its count, and the counts left, about `rest` of the pieces.

    Multiplicative weights: a length's weight falls with the share of its demand that is covered, and its price is
    its length times its weight. A round takes the dearest configuration half as often as the least of its lengths
    allows (rounded up), so every use is whole; one that leaves room gives way to another, priced by length alone
    over other lengths, which fills the sequence where any choice does.
    """
    draw = np.random.default_rng(seed)
    demand, left = np.maximum(counts, 1).astype(float), counts.copy()
    used: list[tuple[dict[int, int], int]] = []
    enough = rest * counts.sum()
    for _ in range(rounds):
        open_ = np.flatnonzero(left)
        if left.sum() <= enough or not len(open_):
            break
        for turn in range(4):
            chosen = open_
            if len(open_) > 2 * PRICED:
                chosen = np.concatenate([open_[-PRICED:], draw.choice(open_[:-PRICED], PRICED, False)])
            weight = np.exp(-rate * (1 - left[chosen] / demand[chosen])) if turn == 0 else 1.0
            config = dearest(chosen, left[chosen], chosen * weight, capacity)
            if sum(k * a for k, a in config.items()) == capacity:
                break
        many = max(1, min(int(left[k]) // a for k, a in config.items()) // 2)
        for k, a in config.items():
            left[k] -= a * many
        used.append((config, many))
    return used, left


#: Pieces that the program is solved for at once; it knows shares of lengths, so larger histograms are scaled down to them.
SOLVED = 5000


def scaled_program(counts: np.ndarray, capacity: int, rounds: int, kept: float = 0.3, seed: int = 4) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """program() of ever smaller scales: each one's configurations are used as often as its scale and the counts allow.

    A scale that isn't the last one keeps a share of its pieces back, so that pieces of all lengths reach the next.
    """
    draw = np.random.default_rng(seed)
    used, left = [], counts.copy()
    while True:
        scale = max(1, int(left.sum()) // SOLVED)
        scaled = left if scale == 1 else np.floor(left / scale + draw.random(len(left))).astype(np.int64)
        part, _ = program(scaled, capacity, rounds, *(() if scale == 1 else (kept,)))
        placed = 0
        for config, many in part:
            many = min(many * scale, *(int(left[k]) // a for k, a in config.items()))
            if many:
                used.append((config, many))
                for k, a in config.items():
                    left[k] -= a * many
                    placed += a * many
        if scale == 1 or not placed:
            return used, left


def best_fit(left: np.ndarray, capacity: int, begun: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Longest first into the fullest sequence with room, of those begun and new ones; equal sequences are one entry with a count."""
    room: dict[int, list[list]] = defaultdict(list)
    for config, many in begun:
        room[capacity - sum(k * a for k, a in config.items())].append([config, many])
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fit = min((r for r, groups in room.items() if r >= length and groups), default=None)
            if fit is None:
                each = min(n, capacity // length)
                many = n // each
                room[capacity - each * length].append([{length: each}, many])
                n -= each * many
                continue
            config, many = room[fit].pop()
            each = min(fit // length, max(1, n // many))
            take = min(many, n // each)
            if take < many:
                room[fit].append([config, many - take])
            room[fit - each * length].append([config | {length: config.get(length, 0) + each}, take])
            n -= each * take
    return [(config, many) for groups in room.values() for config, many in groups]


def plan(histogram: dict[int, int], capacity: int, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """(configuration, number of sequences) that hold every piece of the histogram once.

    The program places all but a few pieces; best fit puts those into the room left and into new sequences. Where
    best fit alone needs fewer sequences, its plan is taken.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    whole = [({capacity: 1}, int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    used, left = scaled_program(counts, capacity, rounds)
    planned, plain = best_fit(left, capacity, used), best_fit(counts, capacity)
    return whole + min(planned, plain, key=lambda p: sum(many for _, many in p))


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None, rounds: int = 4000) -> DataFrame:
    """Every piece of docs with its sequence and its place there.

    A null or empty text is one piece of the end id alone; longer ones than capacity are cut, the last piece may be
    shorter; repeated rows are pieces of their own; an empty table gives no rows. Other columns of docs are ignored.
    """
    pieces = stored(token_pieces(docs, capacity, end_id, path or tokenizer_path()), "pieces")
    histogram = pieces.groupBy("length").count()
    rows = histogram.collect()  # at most `capacity` rows
    planned = plan({r["length"]: r["count"] for r in rows}, capacity, rounds)
    # for each length: ranks from `first` on, `each` of them to a sequence
    used: dict[int, int] = defaultdict(int)
    table, sequence = [], 0
    for config, many in planned:
        offset = 0
        for length, each in config.items():
            table.append((length, used[length], each, sequence, offset))
            used[length] += each * many
            offset += each * length
        sequence += many
    grid = np.array(sorted(table), np.int64).reshape(-1, 5)
    keys = (grid[:, 0] << 44) + grid[:, 1]
    shared = docs.sparkSession.sparkContext.broadcast((keys, grid))

    total = sum(r["count"] for r in rows)
    cell = max(256, total // 8192)
    parts = F.broadcast(histogram.select(F.col("length").alias("_length"), F.ceil(F.col("count") / cell).alias("_parts")))  # at most `capacity` rows
    ranked = pieces.join(parts, F.col("length") == F.col("_length")).withColumn("_o", F.xxhash64("doc_id", "piece", "start")).withColumn("_cell", F.pmod("_o", "_parts"))
    cells = ranked.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    # at most capacity + 8192 cells
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = F.broadcast(cells.select(F.col("length").alias("_l"), F.col("_cell").alias("_c"), before.alias("_before")))
    ranked = ranked.join(cells, (F.col("length") == F.col("_l")) & (F.col("_cell") == F.col("_c")))
    inside = Window.partitionBy("length", "_cell").orderBy("_o", "doc_id", "piece", "ids_crc32")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.row_number().over(inside) - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, grid = shared.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            row = grid[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            nth, within = np.divmod(rank - row[:, 1], np.maximum(row[:, 2], 1))
            more = [pa.array(row[:, 3] + nth), pa.array(row[:, 4] + within * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed; see pack()."""
    return pack(documents(spark, sf_dir))
