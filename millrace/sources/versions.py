"""Tables in versions: immutable folders and a list of commits, each put in place by one rename, with failures on record.

Layout under a root: ``data/<id>`` (Parquet, never changed), ``commits/<n>.json`` (which folder is version n) and
``failures/<id>.json``. A reader takes the folder of the last commit, so it sees a whole version or the one before; a
folder whose commit never came is never read. All of it goes through Hadoop's file system of the root.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A check of a staged table: null if it may be committed, else why not.
Check = Callable[[DataFrame], str | None]

FAILURE = "id string, at double, stage string, error string, based_on long"
COMMIT = "version long, folder string, at double, rows long, metadata map<string,string>"


class Conflict(Exception):
    """Another writer has committed since the version that this one is based on."""


class Rejected(Exception):
    """A check refused the staged table."""


class _Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a file aside and rename it into place; false if the place is taken."""
        folder = name.rsplit("/", 1)[0]
        aside = self.path(f"{folder}/.{uuid.uuid4().hex}")
        self.fs.mkdirs(self.path(folder))
        stream = self.fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        place = self.path(name)
        if self.fs.exists(place) or not self._renamed(aside, place):
            self.fs.delete(aside, False)
            return False
        return True

    def _renamed(self, aside, place) -> bool:
        """A rename that never replaces: local files by a hard link, others by their file system's own rename."""
        if self.fs.getScheme() == "file":
            import os

            try:
                os.link(aside.toUri().getPath(), place.toUri().getPath())
            except FileExistsError:
                return False
            self.fs.delete(aside, False)
            return True
        return bool(self.fs.rename(aside, place))


def commits(spark: SparkSession, root: str) -> list[dict]:
    """All commits in order: version, folder, at, rows, metadata."""
    files = _Files(spark, root)
    return [json.loads(files.read(f"commits/{name}")) for name in files.names("commits") if not name.startswith(".")]


def latest(spark: SparkSession, root: str) -> dict | None:
    files = _Files(spark, root)
    names = [n for n in files.names("commits") if not n.startswith(".")]
    return json.loads(files.read(f"commits/{names[-1]}")) if names else None


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The last version, or the one asked for. What is read stays as it is, whatever is committed meanwhile."""
    found = latest(spark, root) if version is None else next((c for c in commits(spark, root) if c["version"] == version), None)
    if found is None:
        raise ValueError(f"{root} has no version{'' if version is None else f' {version}'}")
    return spark.read.parquet(f"{root.rstrip('/')}/{found['folder']}")


def swap(df: DataFrame, root: str, checks: list[Check] = (), metadata: dict[str, str] | None = None, based_on: int | None = -1) -> int:
    """Write df aside, check it, and make it the next version; gives the version's number.

    If writing or a check fails, the staged folder is deleted, one row tells of it under failures, the table stays as
    it was and the error goes on to the caller. based_on: the version that df was made from (null: none; by default
    the last one as of now); if another came since, nothing is committed and Conflict is raised, with a row too.
    """
    spark = df.sparkSession
    files, ident = _Files(spark, root), uuid.uuid4().hex
    folder, stage = f"data/{ident}", "stage"
    last = latest(spark, root)
    base = (last["version"] if last else None) if based_on == -1 else based_on
    try:
        df.write.parquet(f"{files.root}/{folder}")
        stage = "check"
        staged = spark.read.schema(df.schema).parquet(f"{files.root}/{folder}")
        for check in checks:
            refused = check(staged)
            if refused is not None:
                raise Rejected(refused)
        stage, version = "commit", (base or 0) + 1
        commit = {"version": version, "folder": folder, "at": time.time(), "rows": staged.count(), "metadata": metadata or {}}
        last = latest(spark, root)
        if (last["version"] if last else None) != base or not files.put(f"commits/{version:012d}.json", json.dumps(commit)):
            raise Conflict(f"version {base} is not the last one of {root}")
        return version
    except BaseException as error:
        files.fs.delete(files.path(folder), True)
        row = {"id": ident, "at": time.time(), "stage": stage, "error": f"{type(error).__name__}: {error}"[:2000], "based_on": base}
        files.put(f"failures/{ident}.json", json.dumps(row))
        raise


def rollback(spark: SparkSession, root: str, version: int) -> int:
    """Make an earlier version the last one again, as a commit of its own; its folder is used as it is."""
    found = next((c for c in commits(spark, root) if c["version"] == version), None)
    if found is None:
        raise ValueError(f"{root} has no version {version}")
    number = latest(spark, root)["version"] + 1
    commit = found | {"version": number, "at": time.time(), "metadata": found["metadata"] | {"rolled_back_to": str(version)}}
    if not _Files(spark, root).put(f"commits/{number:012d}.json", json.dumps(commit)):
        raise Conflict(f"version {number} of {root} was committed meanwhile")
    return number


def failures(spark: SparkSession, root: str) -> DataFrame:
    """One row for each swap that failed: id, at, stage (stage, check or commit), error, based_on."""
    files = _Files(spark, root)
    rows = [json.loads(files.read(f"failures/{n}")) for n in files.names("failures") if not n.startswith(".")]
    return spark.createDataFrame([(r["id"], r["at"], r["stage"], r["error"], r["based_on"]) for r in rows], FAILURE)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete folders that no commit names any more once the last `keep` versions are kept; readers of older ones lose them."""
    files, kept = _Files(spark, root), {c["folder"] for c in commits(spark, root)[-keep:]}
    gone = [n for n in files.names("data") if f"data/{n}" not in kept]
    for name in gone:
        files.fs.delete(files.path(f"data/{name}"), True)
    return gone


def at_least(rows: int) -> Check:
    return lambda df: None if df.limit(rows).count() >= rows else f"fewer than {rows} rows"


def unique(*keys: str) -> Check:
    """No two rows of one key, nulls included."""
    return lambda df: "repeated key" if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() else None
