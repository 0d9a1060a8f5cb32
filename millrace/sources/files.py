"""Files as rows: their checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file under path. A task holds one file at a time, of at most 2 GB.

    Spark's file sources skip empty files, so those have no row.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
