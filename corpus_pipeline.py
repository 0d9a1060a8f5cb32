"""A corpus pipeline: language identification, near-duplicate removal, mixing to source weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import documents, stored
from millrace.llm.langid import confident
from millrace.llm.mixing import mixed_documents
from millrace.llm.neardup import one_of_each
from millrace.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is named surely enough, all columns as they came.

    Null texts, empty ones and those without a letter go; a null doc_id, lang or source decides nothing; rows of equal
    text stay or go together; an empty table, or one without labels, gives no rows.
    """
    return confident(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least doc_id, all columns as they came.

    Null texts are one class; a null doc_id is the least only among nulls; of equal rows one stays; texts that share
    an id but no class stay; an empty table gives no rows.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, all columns as they came.

    Null texts and texts without words have size 0 and are taken in every pass that reaches their place; a null source
    is a source; equal rows share what is taken of them evenly; an empty table gives no rows.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and place.

    A null or empty text is the end id alone; a long text is cut; repeated rows are pieces of their own; other columns
    play no part; an empty table gives no rows.
    """
    return pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Trained models and tokenizers decide here; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows stored before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
