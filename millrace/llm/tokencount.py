"""Operator 8: token counts by a count-only Viterbi search.

A unigram tokenizer takes, of all ways to cut a word into vocabulary pieces, one of the highest summed score. Only
the number of pieces is wanted, so the search keeps, for each place, the best score and its piece count and no path.
An Aho-Corasick automaton lists the pieces that end at each place, longest first. Ties go as in the tokenizer: a
later candidate must be strictly better, and the longest piece comes first. A character that no piece of one
character covers may be an unknown piece, scored `unknown_penalty` under the least score; neighbouring unknown
pieces are one token. Words are runs of non-space characters behind the mark of a word's start; no piece spans two.

The default vocabulary is the piece file of a public BPE tokenizer, read as a unigram model with its scores. Its own
encoder merges pairs by rank and gives other counts; the counts here are those of a unigram tokenizer over that file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

START = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 400_000


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids]


class PieceCounts(dict):
    """Number of tokens of a run of non-space characters, by its UTF-8 bytes."""

    def __init__(self, vocabulary: list[tuple[str, float]], mark: str = START):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(piece) for piece, _ in vocabulary)
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.mark = mark

    def count(self, text: str) -> int:
        width = self.longest + 1
        # of place i, at i modulo width: best score, pieces, whether the last one is unknown
        best, pieces, last_unknown = [0.0] * width, [0] * width, [False] * width
        matches: list[tuple[int, float]] = []
        found = self.automaton.iter(text)
        coming = next(found, None)
        for end in range(len(text)):
            matches.clear()
            while coming and coming[0] == end:
                matches.append(coming[1])
                coming = next(found, None)
            matches.sort(reverse=True)
            top, n, unknown, single = -float("inf"), 0, False, False
            for length, score in matches:
                at = (end + 1 - length) % width
                single = length == 1
                if best[at] + score > top:
                    top, n, unknown = best[at] + score, pieces[at] + 1, False
            at = end % width
            if not single and best[at] + self.unknown > top:
                top, n, unknown = best[at] + self.unknown, pieces[at] + (not last_unknown[at]), True
            at = (end + 1) % width
            best[at], pieces[at], last_unknown[at] = top, n, unknown
        return pieces[len(text) % width]

    def __missing__(self, run: bytes) -> int:
        n = self.count(self.mark + run.decode("utf-8", "surrogatepass"))
        if len(self) < CACHED_WORDS and len(run) <= 64:
            self[run] = n
        return n


_counters: dict[str, PieceCounts] = {}


def counter(path: str) -> PieceCounts:
    if path not in _counters:
        _counters[path] = PieceCounts(read_vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of each row's whole text.

    A null or empty text has none of either. Repeated rows are rows of their own; an empty table gives no rows; other
    columns are ignored. A text of one very long word is searched in one pass over it
    that keeps as many places as the longest piece has characters.
    """
    path = path or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            words, total = [], []
            for text in batch.column(1):
                runs = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                words.append(len(runs))
                total.append(sum(map(tokens.__getitem__, runs)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents; see count_tokens()."""
    return count_tokens(documents(spark, sf_dir))
