"""What the operators of this folder share: the shared folder, stored intermediate tables, guarded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast; above it the planner chooses.
BROADCAST_ROWS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again: computed once, its lineage cut, safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables; nothing that is still to be computed may read them."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def own_names(columns: list[str], *wanted: str) -> list[str]:
    """Each wanted name, with underscores put before it until no column has it (in any case of its letters)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of one key that a join deals to one task.
KEY_ROWS = 64


def join_hot(rows: DataFrame, key: str, values: DataFrame, spread_by: list[str]) -> DataFrame:
    """rows joined with values (h and more, a row for each h) on key = h; a key of very many rows is dealt over many tasks.

    Only keys over a share of the rows are dealt so; they are 50,000 at most, so their list may go to the driver.
    """
    total = rows.count()
    most = max(KEY_ROWS, total // 50_000)
    parts = F.ceil(F.count(F.lit(1)) / most).cast("int")
    found = rows.groupBy(F.col(key).alias("_hot")).agg(parts.alias("_parts")).where("_parts > 1").collect() if total > most else []
    if not found:
        return rows.join(values.withColumnRenamed("h", "_h"), F.col(key) == F.col("_h")).drop("_h")
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, "_hot long, _parts int"))
    dealt = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread_by), "_parts"))
    dealt = dealt.withColumn("_part", part.cast("int")).drop("_hot", "_parts")
    copied = values.join(hot, F.col("h") == F.col("_hot"), "left")
    copied = copied.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts").withColumnRenamed("h", "_h")
    return dealt.join(copied, (F.col(key) == F.col("_h")) & (F.col("_part") == F.col("_copy"))).drop("_h", "_part", "_copy")


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its row count is within the limit, else df itself, joined by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows out evenly where a scan gives fewer tasks than the session's shuffle width."""
    width = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width)
