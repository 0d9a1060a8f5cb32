"""Keys of keyed state as texts that are never null: a null among numbers would turn a batch's keys into floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit(""))


def unnamed(c: Column, kind: str) -> Column:
    """The value of a named key, null for the empty one."""
    return F.when(c != "", F.substring(c, 2, 2**31 - 1).cast(kind))
