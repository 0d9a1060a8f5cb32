"""Versions of a table: what an import changes, upserts, replacing children, one active version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(*columns: str) -> Column:
    """A hash of the named columns' values in a canonical form; a null differs from an empty text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, state): inserted, removed, updated or unchanged, by content hash. Only keys and hashes are shuffled."""
    a, b = (df.select(F.col(key), content_hash(*columns).alias(name)) for df, name in ((old, "_old"), (new, "_new")))
    state = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows, and old's whose key new lacks."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old's rows, and new's whose key old lacks."""
    return upsert(new.select(*old.columns), old, key)


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """The children of every parent that fresh names are fresh's; other children stay."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").select(*children.columns).unionByName(fresh.select(*children.columns))


def activate(versions: DataFrame, version: str, name: str = "version", status: str = "status") -> DataFrame:
    """versions with the one named ACTIVE and the one that was ACTIVE now INACTIVE; only a VALIDATED one can be made active."""
    allowed = (F.col(name) == version) & F.col(status).isin("VALIDATED", "ACTIVE")
    ready = F.max(allowed.cast("int")).alias("_ready")
    checked = versions.crossJoin(F.broadcast(versions.agg(ready)))  # one row
    new = F.when(F.col("_ready") == 0, F.col(status)).when(F.col(name) == version, "ACTIVE").when(F.col(status) == "ACTIVE", "INACTIVE").otherwise(F.col(status))
    return checked.withColumn(status, new).select(*versions.columns)


def pinned(versions: DataFrame, version: str, metadata: dict[str, object], experimental: bool = False, name: str = "version", status: str = "status") -> DataFrame:
    """The one row of a version that may be read; a LookupError where there is none or its metadata are others."""
    allowed = ["VALIDATED", "ACTIVE"] + ["EXPERIMENTAL"] * experimental
    found = versions.where((F.col(name) == version) & F.col(status).isin(*allowed)).limit(1)
    row = found.first()
    if row is None:
        raise LookupError(f"version {version!r} is not available")
    if unlike := [c for c, wanted in metadata.items() if row[c] != wanted]:
        raise LookupError(f"version {version!r} differs in {', '.join(unlike)}")
    return found
