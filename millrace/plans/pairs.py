"""Pair review of documents as records; the SQL compares every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import review
from ..session import checkpoints, table


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the title of the first sentence as name, long words as ingredients, the language as method."""
    docs = table(spark, sf_dir, "documents")
    core = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{8,})"), F.lit(1)))
    name = text.title(F.regexp_extract("text", r"^([^.\n]*)", 1))
    return docs.select(F.col("doc_id").alias("ordinal"), name.alias("name"), core.alias("core"), F.array("lang").alias("methods"), F.col("text").alias("steps"), F.col("lang").alias("category"))


def pair_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on pairs of documents, names compared by edit distance."""
    checkpoints(spark)
    return review.pair_reviews(document_records(spark, sf_dir), "edit")


def pair_review_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on pairs of documents, names compared by their matching blocks; SQL has no such measure."""
    checkpoints(spark)
    return review.pair_reviews(document_records(spark, sf_dir))


def review_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the review rejects."""
    checkpoints(spark)
    return review.rejected_records(document_records(spark, sf_dir), "edit")


def first_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty pairs of documents of one language alike in words and title."""
    return review.first_near_pairs(document_records(spark, sf_dir), measure="edit")


_RECORDS = """
WITH titled AS (
  SELECT doc_id, lang, trim(regexp_replace(regexp_extract(text, '^([^.\\n]*)', 1), '\\s+', ' ', 'g')) AS t, text,
    list_sort(list_distinct(regexp_extract_all(lower(text), '([a-z]{8,})', 1))) AS core FROM documents
), records AS (
  SELECT doc_id, lang, CASE WHEN length(t) > 60 THEN left(t, 59) || '…' ELSE t END AS name, core, text FROM titled
)"""
_RATIO = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1})) END"
_REVIEWS = (
    _RECORDS
    + """, kinds AS (
  SELECT regexp_replace(lower(name), '[^0-9a-z\\x{4e00}-\\x{9fff}]', '', 'g') AS k, core, lang, regexp_replace(lower(text), '[^0-9a-z\\x{4e00}-\\x{9fff}]', '', 'g') AS steps, min(doc_id) AS id
  FROM records GROUP BY ALL
), pairs AS (
  SELECT l.id AS left_id, r.id AS right_id, l.k = r.k AS same_name, """
    + _RATIO.format("l.k", "r.k")
    + """ AS name, (l.lang = r.lang)::INT::DOUBLE AS methods, l.steps AS ls, r.steps AS rs,
    CASE WHEN len(l.core) + len(r.core) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(l.core, r.core))::DOUBLE / (len(l.core) + len(r.core) - len(list_intersect(l.core, r.core))) END AS ingredients
  FROM kinds l JOIN kinds r ON l.id < r.id
), judged AS (
  SELECT *, CASE WHEN same_name THEN 'REJECT_RIGHT' WHEN ingredients >= 0.8 AND methods >= 0.99 AND name >= 0.55 THEN 'REJECT_RIGHT'
    WHEN (ingredients >= 0.65 AND methods >= 0.99) OR name >= 0.78 THEN 'HUMAN_REVIEW' END AS decision
  FROM pairs WHERE name >= 0.45 OR ingredients >= 0.5
), grams AS (
  SELECT *, list_distinct(list_transform(range(1, length(ls) - 1), lambda i: substring(ls, i, 3))) AS lg, list_distinct(list_transform(range(1, length(rs) - 1), lambda i: substring(rs, i, 3))) AS rg
  FROM judged WHERE decision IS NOT NULL
), reviews AS (
  SELECT left_id, right_id, same_name, round(name, 4) AS name, round(ingredients, 4) AS ingredients, round(methods, 4) AS methods,
    round(CASE WHEN len(lg) + len(rg) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(lg, rg))::DOUBLE / (len(lg) + len(rg) - len(list_intersect(lg, rg))) END, 4) AS steps, decision FROM grams
)"""
)

QUERIES = {"pair_review": pair_review, "pair_review_blocks": pair_review_blocks, "review_rejected": review_rejected, "first_near_pairs": first_near_pairs}
ORACLES = {
    "pair_review": _REVIEWS + " SELECT * FROM reviews",
    "review_rejected": _REVIEWS
    + """, numbered AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY regexp_replace(lower(name), '[^0-9a-z\\x{4e00}-\\x{9fff}]', '', 'g'), core, lang, regexp_replace(lower(text), '[^0-9a-z\\x{4e00}-\\x{9fff}]', '', 'g')) AS kind FROM records
) SELECT doc_id AS id FROM numbered WHERE doc_id <> kind OR kind IN (SELECT right_id FROM reviews WHERE decision = 'REJECT_RIGHT')""",
    "first_near_pairs": _RECORDS
    + """ SELECT left_id, right_id FROM (
  SELECT l.doc_id AS left_id, r.doc_id AS right_id, """
    + _RATIO.format("l.name", "r.name")
    + """ AS name,
    CASE WHEN len(l.core) + len(r.core) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(l.core, r.core))::DOUBLE / (len(l.core) + len(r.core) - len(list_intersect(l.core, r.core))) END AS ingredients
  FROM records l JOIN records r ON l.doc_id < r.doc_id AND l.lang = r.lang
) WHERE ingredients >= 0.65 AND name >= 0.6 ORDER BY left_id, right_id LIMIT 20""",
}
