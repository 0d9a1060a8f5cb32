"""Vectors by content: what was computed once is read again, batches that fail are halved until the bad item stands alone."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts to vectors, one for each; raises if any of them is refused.
Compute = Callable[[Sequence[str]], Sequence[Sequence[float]]]
RESULT = "key string, kind string, text_hash string, vector array<double>, error string, requests int"


def keyed(items: DataFrame, model: str, kind: str, template: str) -> DataFrame:
    """items (text) with text_hash and key: one and the same for equal texts of one model, kind and template."""
    text_hash = F.sha2(F.coalesce("text", F.lit("")), 256)
    return items.withColumn("text_hash", text_hash).withColumn("key", F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(kind), F.lit(template), text_hash), 256))


def bisected(texts: list[str], compute: Compute, dimension: int | None = None) -> tuple[list[tuple], int]:
    """(vector, error) of each text and the number of requests: a batch that fails goes in halves, a single one is an error.

    A wrong number of vectors, an empty or uneven one, one of another dimension, or a value that is not finite is a failure.
    """
    requests, out = 0, [(None, None)] * len(texts)
    open_ = [(0, len(texts))] if texts else []
    while open_:
        start, stop = open_.pop()
        requests += 1
        try:
            vectors = [[float(x) for x in v] for v in compute(texts[start:stop])]
            if len(vectors) != stop - start:
                raise ValueError("wrong number of vectors")
            if any(not v or len(v) != (dimension or len(vectors[0])) or not all(map(math.isfinite, v)) for v in vectors):
                raise ValueError("wrong dimension or value")
            out[start:stop] = [(v, None) for v in vectors]
        except Exception as error:
            if stop - start == 1:
                out[start] = (None, type(error).__name__)
            else:
                middle = (start + stop) // 2
                open_ += [(middle, stop), (start, middle)]
    return out, requests


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(key, vector) of everything that was ever computed without error; a key that two runs computed has one row."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    schema = RESULT + ", run string"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).select("key", "vector")
    found = spark.read.schema(schema).parquet(root)
    return found.where("error is null").groupBy("key").agg(F.min_by("vector", "run").alias("vector"))


def cached(items: DataFrame, root: str, compute: Compute, model: str, kind: str = "document", template: str = "v1", batch: int = 16, dimension: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """items with vector and error, and the counts of distinct texts: hits, misses, writes, failures, and of requests.

    Only texts that the cache lacks are computed, each once; the run's own folder under the root is written by one
    job and then read, so a task that is run again changes nothing. Errors are kept as rows of the run and are tried
    again in the next. Null texts are empty ones; repeated items share a vector; columns of items named vector,
    error, key or text_hash give way.
    """
    if batch < 1:
        raise ValueError("a batch has one text at least")
    spark, run = items.sparkSession, uuid.uuid4().hex
    rows = keyed(items.drop("vector", "error", "key", "text_hash"), model, kind, template)
    wanted = rows.groupBy("key", "text_hash").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    missing = wanted.join(entries(spark, root), "key", "left_anti")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                results, requests = bisected(part["text"].tolist(), compute, dimension)
                vectors, errors = zip(*results)
                yield pd.DataFrame({"key": part["key"].tolist(), "kind": kind, "text_hash": part["text_hash"].tolist(), "vector": vectors, "error": errors, "requests": [requests] + [0] * (len(part) - 1)})

    missing.select("key", "text_hash", "text").mapInPandas(each, RESULT).withColumn("run", F.lit(run)).write.mode("append").parquet(root)
    own = spark.read.schema(RESULT + ", run string").parquet(root).where(F.col("run") == run)
    misses, failures, requests = own.agg(F.count(F.lit(1)), F.count("error"), F.coalesce(F.sum("requests"), F.lit(0))).first()
    stats = {"hits": wanted.count() - misses, "misses": misses, "writes": misses - failures, "failures": failures, "requests": requests}
    out = rows.join(entries(spark, root), "key", "left").join(own.where("error is not null").select("key", "error"), "key", "left")
    return out.drop("key", "text_hash"), stats
