"""Records of other sources: any parser with its faults as rows, bounded batches of made-up records, signatures of images."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One record, as its JSON tells it, to the fields of a row; ValueError, TypeError or KeyError refuses it.
Parser = Callable[[dict[str, Any]], dict[str, Any]]

# First bytes of each kind of image in hexadecimal, `..` for any byte.
SIGNATURES = {"image/jpeg": "FFD8FF", "image/png": "89504E470D0A1A0A", "image/webp": "52494646........57454250"}
MOST_MADE = 10


def parsed(records: DataFrame, parser: Parser, schema: T.StructType, ident: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows of schema, rejected as record_id, code, message): every record, a row of JSON text `value`, is in just one.

    record_id is the record's own under `ident`, else `public-record-` and its ordinal from 1, or null without an
    ordinal column. A parser works on a record at a time and its faults never end the job; text that is no JSON object,
    and a row that the schema refuses, are faults too. Each record is parsed once and both results read what was stored.
    """
    ordinal = F.col("ordinal") if "ordinal" in records.columns else F.lit(None)
    out = T.StructType([T.StructField("row", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("message", T.StringType())])
    names = schema.fieldNames()

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = []
            for value, n in zip(frame["value"], frame["ordinal"]):
                record = None
                try:
                    record = json.loads(value)
                    if not isinstance(record, dict):
                        raise ValueError("record is not an object")
                    row = parser(record)
                    told.append((json.dumps({k: row.get(k) for k in names}, ensure_ascii=False), None, None))
                except (ValueError, TypeError, KeyError, AttributeError) as error:
                    own = record.get(ident) if isinstance(record, dict) else None
                    told.append((None, str(own) if own else None if pd.isna(n) else f"public-record-{int(n)}", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(told, columns=["row", "record_id", "message"])

    read = records.select("value", ordinal.cast("long").alias("ordinal")).mapInPandas(each, out)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    read = read.withColumn("_r", F.from_json("row", wide, {"columnNameOfCorruptRecord": "_corrupt"})).checkpoint()
    refused = F.col("row").isNull() | F.col("_r._corrupt").isNotNull()
    message = F.coalesce("message", F.lit("TypeError: row does not fit the schema"))
    rejected = read.where(refused).select("record_id", F.lit("SOURCE_PARSE_FAILED").alias("code"), message.alias("message"))
    return read.where(~refused).select(*(F.col(f"_r.{n}").alias(n) for n in names)), rejected


def made(spark: SparkSession, kinds: list[str], count: int, fields: dict[str, Column]) -> DataFrame:
    """`count` records (1 to 10) of each kind: kind, number from 1, record_id and the fields, columns over kind and number."""
    if not 1 <= count <= MOST_MADE:
        raise ValueError(f"a batch has 1 to {MOST_MADE} records")
    rows = spark.range(len(kinds)).select(F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") + 1).cast("int")).alias("kind"), F.explode(F.sequence(F.lit(1), F.lit(count))).alias("number"))
    return rows.select("kind", "number", F.concat_ws("-", F.lit("synthetic"), F.lower("kind"), F.lpad(F.col("number").cast("string"), 3, "0")).alias("record_id"), *(c.alias(k) for k, c in fields.items()))


def image_type(data: Column) -> Column:
    """The kind of image that the first bytes tell, or null."""
    head, out = F.hex(F.substring(data, 1, 12)), F.lit(None).cast("string")
    for kind, signature in SIGNATURES.items():
        out = F.when(head.rlike(f"^{signature}"), kind).otherwise(out)
    return out


def signature_fits(declared: Column, data: Column) -> Column:
    """Whether bytes are of the declared kind; false where either is null or the kind is not known."""
    return F.coalesce(image_type(data) == F.lower(declared), F.lit(False))
