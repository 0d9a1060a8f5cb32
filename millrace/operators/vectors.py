"""Dense and sparse vectors: cosine, exact top-k for a stated query set, TF-IDF, fusion of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def top_k(scored: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    """The k best items of each query by rounded score, ties by item; adds rank from 1."""
    order = Window.partitionBy(query).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(items: DataFrame, queries: DataFrame, k: int, item: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, item_id, score, rank) of the k nearest items of each query by exact cosine, itself left out.

    queries: (query_id, query_vector), a stated set. A score is null, and comes last, where a value is null or two lengths differ (0 where a length is none).
    """
    return mixed_nearest(items, queries, k, [(0, None)], [1.0], blocks.DIGITS, item, vector)


def mixed_nearest(
    items: DataFrame, queries: DataFrame, k: int, parts: list[tuple[int, int | None]], weights: list[float], digits: int, item: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """nearest, by the weighted sum of the cosines of the vectors' parts (start and end, from 0); cosines are rounded, then the sum."""
    rows = items.select(F.col(item).alias("id"), F.col(vector).alias("v"))
    asked = queries.select(F.col("query_id").alias("id"), F.col("query_vector").alias("v"))
    return top_k(blocks.best_of_tasks(rows, asked, k, parts, weights, digits), "query_id", "item_id", "score", k)


def tfidf(tokens: DataFrame, doc: str = "doc_id", term: str = "term") -> tuple[DataFrame, DataFrame]:
    """From rows (doc, term): unit-length weights (doc, term, w) and (term, idf) with idf = ln((1 + N) / (1 + df)) + 1."""
    counts = tokens.groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf"))
    n = tokens.select(doc).distinct().agg(F.count(F.lit(1)).alias("n"))
    idf = counts.groupBy(term).agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select(term, (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, term).withColumn("raw", F.col("tf") * F.col("idf"))
    size = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("size"))
    return raw.join(size, doc).select(doc, term, (F.col("raw") / F.col("size")).alias("w")), idf


def fuse(lanes: list[tuple[DataFrame, float]], constant: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of (query_id, item_id, rank) lanes: sum of weight / (constant + rank)."""
    parts = [lane.select("query_id", "item_id", (F.lit(weight) / (constant + F.col("rank"))).alias("part")) for lane, weight in lanes]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "item_id").agg(F.round(F.sum("part"), 8).alias("score"))
