"""Operator 9: language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams; a softmax over that average names the language.
Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled documents (`sample` in all,
shared evenly by the languages, taken by smallest hash of the id). A part of the sample, kept out of training, sets
the temperature of the scores and the score under which a prediction is rejected. As everything before the softmax
is linear, embeddings and softmax fold into one score per n-gram and language for prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, own_names

BUCKETS = 1 << 14
ORDERS = (2, 3, 4)
#: Bytes of text that are hashed at once; a longer text is a batch of its own.
CHUNK = 1 << 18
#: Texts that a task takes out of a batch at once.
TEXTS = 256
UNKNOWN = "und"


def ngrams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order, bucket of the n-gram at each place)."""
    x = data.astype(np.uint32)
    h = x
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ x[n - 1 :] if len(h) > 1 else h[:0]
        if n in ORDERS:
            yield n, ((h * np.uint32(0x9E3779B1) + np.uint32(n * 0x7FEB352D & 0xFFFFFFFF)) >> np.uint32(32 - 14)).astype(np.int64)


def prepared(text: str | None) -> bytes:
    """UTF-8 bytes, A-Z lower-cased, with a space at either end."""
    return b" " + (text or "").encode("utf-8", "surrogatepass").lower() + b" "


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    found = np.concatenate([b for _, b in ngrams(np.frombuffer(prepared(text), np.uint8))])
    total = np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / max(1, len(found))).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language
    bias: np.ndarray
    scale: float  # logits are multiplied by it: the calibrated temperature
    least: float  # predictions below this score are rejected


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], width: int = 16, epochs: int = 6, rate: float = 0.3, seed: int = 1) -> Model:
    """rows: (language, buckets, shares). Adagrad steps of one document each, in a seeded order."""
    languages = sorted({r[0] for r in rows})
    index = {k: i for i, k in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    kept_out = max(1, len(rows) // 5) if len(rows) >= 10 else 0
    train, check = order[kept_out:], order[:kept_out]
    table = rng.normal(0, 0.1, (BUCKETS, width)).astype(np.float32)
    head, bias = rng.normal(0, 0.1, (width, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    table_sq, head_sq = np.full(BUCKETS, 1e-8, np.float32), np.full(head.shape, 1e-8, np.float32)
    weight = np.array([len(train) / max(1, sum(index[rows[i][0]] == k for i in train)) / len(languages) for k in range(len(languages))])
    for _ in range(epochs):
        for i in rng.permutation(train):
            lang, at, share = rows[i]
            mean = share @ table[at]
            off = softmax(mean @ head + bias)
            off[index[lang]] -= 1
            off *= weight[index[lang]]
            back = np.outer(share, head @ off)
            head_grad = np.outer(mean, off)
            table_sq[at] += (back * back).sum(axis=1)
            head_sq += head_grad * head_grad
            table[at] -= rate * back / np.sqrt(table_sq[at])[:, None]
            head -= 0.5 * rate * head_grad / np.sqrt(head_sq)
            bias -= 0.02 * off
    model = Model(languages, (table @ head).astype(np.float32), bias, 1.0, 0.0)
    if kept_out:
        logits = np.array([rows[i][2] @ model.scores[rows[i][1]] + bias for i in check])
        truth = np.array([index[rows[i][0]] for i in check])
        loss = {s: -np.log(np.maximum(softmax(logits * s)[np.arange(len(truth)), truth], 1e-12)).mean() for s in (0.25, 0.5, 1.0, 2.0, 4.0)}
        model.scale = min(loss, key=loss.get)
        sure = softmax(logits * model.scale)
        right = np.sort(sure.max(axis=1)[sure.argmax(axis=1) == truth])
        # as good as every correctly named document of the check part passes
        model.least = float(min(0.5, 0.9 * right[int(0.001 * len(right))])) if len(right) else 0.0
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def train(docs: DataFrame, sample: int = 2400) -> Model | None:
    """A model from at most `sample` labelled documents outside the held-out third, or None where there are none."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(F.col("doc_id")), F.lit(True)))
    hashed = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    per_lang = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    each = max(1, sample // max(1, per_lang.count()))
    # a hash threshold keeps about twice the wanted rows of each language, then the smallest hashes are ranked; equal
    # rows (ids may repeat or be null) have equal hashes and count as one
    share = F.least(F.lit(1.0), F.lit(2.0 * each + 50) / F.col("_n"))
    largest = F.broadcast(per_lang.orderBy(F.desc("_n"), "lang").limit(sample).withColumnRenamed("lang", "_lang"))
    near = hashed.drop("text").join(largest, F.col("lang") == F.col("_lang")).where((F.col("_h") / 2.0**64 + 0.5) <= share).select("lang", "_h").distinct()
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_r") <= each)
    ranked = F.broadcast(ranked.select(F.col("lang").alias("_lang"), F.col("_h").alias("_hash")))  # at most `sample` rows
    chosen = hashed.join(ranked, (F.col("lang") == F.col("_lang")) & (F.col("_h") == F.col("_hash")), "left_semi")
    chosen = chosen.dropDuplicates(["lang", "_h"]).select("lang", "text")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["lang", "at", "share"])

    rows = chosen.mapInArrow(featurize, "lang string, at binary, share binary").collect()  # at most `sample` rows of at most BUCKETS entries
    found = sorted((r["lang"], bytes(r["at"]), bytes(r["share"])) for r in rows)
    return fit([(k, np.frombuffer(a, np.int32), np.frombuffer(s, np.float32)) for k, a, s in found]) if found else None


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes in all."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def text_scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """Probabilities, a row for each text."""
    out = np.zeros((len(texts), len(model.languages)))
    for lo, hi in chunks(texts):
        data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        ends = np.cumsum([len(t) for t in texts[lo:hi]])
        starts = np.concatenate([[0], ends[:-1]])
        total, n_grams = np.zeros((hi - lo, len(model.languages))), np.zeros(hi - lo)
        for n, bucket in ngrams(data):
            # only n-grams inside one text: its last n - 1 places are left out
            first = np.minimum(starts, len(bucket))
            last = np.clip(ends - n + 1, first, len(bucket))
            if not len(bucket):
                continue
            bounds = np.stack([first, np.maximum(last, first)], 1).ravel()
            gram = np.concatenate([model.scores[bucket], np.zeros((1, len(model.languages)), np.float32)])
            sums = np.add.reduceat(gram, bounds, axis=0, dtype=np.float64)[::2]
            sums[last <= first] = 0
            total += sums
            n_grams += last - first
        out[lo:hi] = softmax((total / np.maximum(n_grams, 1)[:, None] + model.bias) * model.scale)
    return out


def predicted(docs: DataFrame, name: str, model: Model | None = None, sample: int = 2400) -> DataFrame:
    """docs with a column `name`: a struct of lang_pred, score and rejected; see identify()."""
    model = model or train(docs, sample)
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    if model is None:
        return docs.select("*", nothing.alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts):
        names, score = [np.zeros(0, object)], [np.zeros(0)]
        for lo in range(0, len(texts), TEXTS):
            sure = text_scores(shared.value, [prepared(t.as_py()) for t in texts.slice(lo, TEXTS)])
            best = sure.argmax(axis=1)
            names.append(np.array(shared.value.languages, object)[best])
            score.append(sure[np.arange(len(best)), best])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(names), pa.string()), pa.array(np.concatenate(score))], names=["lang_pred", "score"])

    found, letters = F.col(name), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    score = F.least(found["score"], F.lit(1.0))
    told = F.struct(found["lang_pred"].alias("lang_pred"), score.alias("score"), (score < model.least).alias("rejected"))
    return docs.select("*", predict("text").alias(name)).withColumn(name, F.when(letters, told).otherwise(nothing))


def identify(docs: DataFrame, model: Model | None = None, sample: int = 2400) -> DataFrame:
    """docs with lang_pred, score and rejected in place of columns of these names.

    A text that is null or has no letter is `und` with score 0 and rejected; so is everything where no document has
    a label to learn from. Ties go to the language first by code point. Empty tables give no rows; repeated rows get
    equal results. lang, source and doc_id play no part in a prediction.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    (name,) = own_names(docs.columns, "_told")
    return predicted(docs, name, model, sample).select(*kept, f"{name}.*")


def confident(docs: DataFrame, model: Model | None = None, sample: int = 2400) -> DataFrame:
    """The rows of docs whose language is named surely enough, with all their columns as they came."""
    (name,) = own_names(docs.columns, "_told")
    return predicted(docs, name, model, sample).where(~F.col(name)["rejected"]).select(*docs.columns)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document; see identify()."""
    out = identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
