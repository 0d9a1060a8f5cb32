"""Line-delimited JSON in and out: strict and tolerant reading with an explicit schema, record ids, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of schema; the first line that isn't one ends the job. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows of schema, rejected lines as code, severity, line); no line ends the job."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    rejected = parsed.where(bad).select(F.lit("SOURCE_PARSE_FAILED").alias("code"), F.lit("ERROR").alias("severity"), F.col("value").alias("line"))
    return parsed.where(~bad).select(*(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields)), rejected


def with_record_id(df: DataFrame, given: str, ordinal: str, name: str = "record_id", prefix: str = "manual-record-") -> DataFrame:
    """The row's own id, or one made from its ordinal."""
    return df.withColumn(name, F.coalesce(F.nullif(F.trim(given), F.lit("")), F.concat(F.lit(prefix), F.col(ordinal).cast("string"))))


def write(df: DataFrame, path: str) -> None:
    """Rows as JSON lines and their schema beside them; a failed job leaves nothing that reads as whole."""
    df.write.mode("overwrite").json(path)
    df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".schema")
