"""Hybrid retrieval over documents and their vectors; the SQL puts the lanes together by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import hybrid
from ..session import checkpoints, table


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their vector as items: long words as parts, the source as scenario, the language as diet."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    name = text.title(F.regexp_extract("text", r"^([^.\n]*)", 1))
    parts = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"), F.lit(1)))
    return docs.select(
        F.col("doc_id").alias("item_id"), name.alias("name"), parts.alias("parts"), F.array("source").alias("scenarios"), text.simple_terms(name).alias("terms"),
        F.array("lang").alias("diets"), (F.col("n_chars") % 120).cast("double").alias("minutes"), (F.col("n_chars") % 7).cast("double").alias("quality"),
        F.col("embedding").alias("vector"), F.when(F.col("doc_id") % 10 == 3, "old").otherwise("v1").alias("dataset"),
    )


def document_queries(items: DataFrame) -> DataFrame:
    """Every item whose id is divisible by 100, as a query for it."""
    none = F.array().cast("array<string>")
    return items.where("item_id % 100 = 0").select(
        F.col("item_id").alias("query_id"), F.col("name").alias("text"), F.slice("parts", 1, 3).alias("parts"), F.when(F.expr("item_id % 300 = 0"), F.col("scenarios")).otherwise(none).alias("scenarios"),
        "terms", F.slice("parts", 1, 1).alias("dish_terms"), F.when(F.expr("item_id % 200 = 0"), F.col("diets")).otherwise(none).alias("diets"),
        F.when(F.expr("item_id % 500 = 0"), F.slice("parts", 4, 1)).otherwise(none).alias("excluded"), F.when(F.expr("item_id % 300 = 0"), 60.0).alias("max_minutes"),
        F.when(F.expr("item_id % 400 = 0"), 100.0).alias("limit"), F.lit(None).cast("double").alias("preference"), "vector",
    )


def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each query by rule and vector lanes, within the current data."""
    checkpoints(spark)
    items = hybrid.in_scope(document_items(spark, sf_dir), 64, dataset="v1").checkpoint()  # texts are read once
    return hybrid.retrieve(items, document_queries(items)).select("query_id", "item_id", F.col("rank").cast("int").alias("rank"), "score", "fused", "coverage", "in_rule", "in_vector")


QUERIES = {"hybrid_retrieval": hybrid_retrieval}
ORACLES = {
    "hybrid_retrieval": """
    WITH t AS (
      SELECT doc_id, trim(regexp_replace(regexp_extract(text, '^([^.\\n]*)', 1), '\\s+', ' ', 'g')) AS t, lang, source, n_chars, embedding::DOUBLE[] AS v,
        regexp_extract_all(lower(text), '([a-z]{9,})', 1) AS words FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 10 <> 3 AND len(embedding) = 64
    ), i AS (
      SELECT doc_id AS id, name, list_filter(words, lambda w, n: list_position(words, w) = n) AS parts, lang, source, list_distinct(regexp_extract_all(lower(name), '([a-z0-9]+)', 1)) AS terms,
        (n_chars % 120)::DOUBLE AS minutes, (n_chars % 7)::DOUBLE AS quality, v, regexp_replace(lower(name), '[^\\p{L}\\p{N}_]+', '', 'g') AS plain
      FROM (SELECT *, CASE WHEN length(t) > 60 THEN left(t, 59) || '…' ELSE t END AS name FROM t)
    ), q AS (SELECT id AS qid, plain AS said, parts[1:3] AS qp, parts[1] AS dish, parts[4] AS fourth, lang AS ql, source AS qs, terms AS qt, v AS qv FROM i WHERE id % 100 = 0),
    met AS (
      SELECT qid, id, quality, CASE WHEN len(qp) > 0 THEN len(list_intersect(parts, qp))::DOUBLE / len(qp) ELSE 0.0::DOUBLE END AS cov, len(qp) AS nq, plain, said, name, dish, (qid % 300 = 0 AND source = qs)::INT AS scen, minutes,
        CASE WHEN len(qt) > 0 THEN len(list_intersect(terms, qt))::DOUBLE / len(qt) ELSE 0.0::DOUBLE END AS tshare, round(list_cosine_similarity(v, qv), 6) AS cosine
      FROM i, q WHERE (qid % 200 <> 0 OR lang = ql) AND (qid % 500 <> 0 OR fourth IS NULL OR NOT list_contains(parts, fourth)) AND (qid % 400 <> 0 OR minutes <= 100)
    ), scored AS (
      SELECT *, round(cov * 8.0::DOUBLE + CASE WHEN nq > 0 AND cov = 1 THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN plain <> '' AND contains(said, plain) THEN 5.0::DOUBLE ELSE 0 END
        + CASE WHEN dish IS NOT NULL AND contains(lower(name), dish) THEN 2.0::DOUBLE ELSE 0 END + scen * 3.0::DOUBLE
        + CASE WHEN qid % 300 <> 0 THEN 0.0::DOUBLE WHEN minutes <= 60 THEN 3.0::DOUBLE + (60 - minutes) / 30 ELSE -least(3.0::DOUBLE, (minutes - 60) / 10) END + tshare + quality * 0.01::DOUBLE, 6) AS rule FROM met
    ), lanes AS (
      SELECT qid, id, 10.0::DOUBLE / (60 + r) AS part, 1 AS lane FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rule DESC, id) AS r FROM scored) WHERE r <= 30
      UNION ALL SELECT qid, id, 1.0::DOUBLE / (60 + r), 2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS r FROM scored) WHERE r <= 30
    ), fused AS (SELECT qid, id, round(sum(part), 8) AS fused, bool_or(lane = 1) AS in_rule, bool_or(lane = 2) AS in_vector FROM lanes GROUP BY qid, id),
    final AS (SELECT f.*, round(fused + cov * 0.02::DOUBLE + scen * 0.005::DOUBLE + quality * 0.0001::DOUBLE, 6) AS score, round(cov, 4) AS coverage FROM fused f JOIN scored USING (qid, id))
    SELECT qid AS query_id, id AS item_id, rank::INT AS rank, score, fused, coverage, in_rule, in_vector
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM final) WHERE rank <= 5""",
}
