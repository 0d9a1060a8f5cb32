"""Session factory and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "millrace", master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with AQE on, UTC time and a shuffle width for small local runs; a cluster passes its own settings."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; columns and filters used later are pushed into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Stored rows of a key or two, sent to all tasks when they are at most so many; else a join shuffles both sides."""
    return rows.hint("broadcast" if rows.count() <= most else "merge")


def checkpoints(spark: SparkSession) -> None:
    """See that checkpoint() has a folder: spark.checkpoint.dir, or one of our own in a local session that names none."""
    import tempfile

    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
    context.setCheckpointDir(named)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so their Python workers can import it."""
    import tempfile
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="millrace-ship-")) / "millrace.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(top.rglob("*.py")):
            archive.write(path, str(path.relative_to(top.parent)))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
