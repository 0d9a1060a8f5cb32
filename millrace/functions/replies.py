"""Replies of models: JSON cut from noise, batches decoded as a whole or not at all, and nested values walked level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_object(c: Column) -> Column:
    """The text from the first opening brace to the last closing one, or null."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def decoded(replies: DataFrame, item: T.StructType, expected: Column, envelope: str, reply: str = "reply") -> DataFrame:
    """replies with `items` (array of item, null if the reply is refused) and `error`.

    A reply is an object with the array under `envelope` and nothing else, or the array itself. Every item must be an
    object with every field of `item` that may not be null, of its type, and no other field; one bad item refuses the
    reply. errors: `json` (no JSON, or text around it; null), `root` (neither form), `item`, `count` (not as many as
    expected). A count is held only against items that are all good.
    """
    root = F.try_parse_json(reply)
    kind = F.schema_of_variant(root)
    # a parser may stop behind the value: inside brackets nothing may stand beside it
    whole = F.size(F.from_json(F.concat(F.lit("["), F.col(reply), F.lit("]")), T.ArrayType(T.StringType()))) == 1
    is_array, is_object = kind.startswith("ARRAY"), kind.startswith("OBJECT")
    outer = F.from_json(reply, T.MapType(T.StringType(), T.StringType()))
    body = F.when(is_array, F.col(reply)).when(is_object & (F.array_join(F.map_keys(outer), ",") == envelope), outer[envelope])
    typed = F.from_json(body, T.ArrayType(item), {"mode": "PERMISSIVE"})
    raw = F.from_json(body, T.ArrayType(T.MapType(T.StringType(), T.VariantType())))
    known = F.array(*(F.lit(f.name) for f in item.fields))
    required = [f.name for f in item.fields if not f.nullable]
    good = lambda x: F.coalesce(F.forall(F.array(*(x[n].isNotNull() for n in required)) if required else F.array(F.lit(True)), lambda b: b), F.lit(False))
    rows = replies.withColumn("_root", kind).withColumn("_typed", typed).withColumn("_raw", raw)
    clean = F.forall("_raw", lambda m: m.isNotNull() & (F.size(F.array_except(F.map_keys(m), known)) == 0))
    # a value of another type is null in the typed form, though the raw form has it; a text must be one
    lacks = lambda v: v.isNull() | F.is_variant_null(v)
    is_text = lambda v, f: F.lit(True) if not isinstance(f.dataType, T.StringType) else lacks(v) | (F.schema_of_variant(v) == "STRING")
    same = lambda p: F.array(*((lacks(p["_raw"][f.name]) == p["_typed"][f.name].isNull()) & is_text(p["_raw"][f.name], f) for f in item.fields))
    fits = F.forall(F.arrays_zip(F.col("_raw").alias("_raw"), F.col("_typed").alias("_typed")), lambda p: F.forall(same(p), lambda q: F.coalesce(q, F.lit(False))))
    every = F.coalesce(F.forall("_typed", good) & clean & fits & (F.size("_typed") == F.size("_raw")), F.lit(False))
    error = (
        F.when(root.isNull() | ~F.coalesce(whole, F.lit(False)) | F.col("_root").isNull(), "json")
        .when(F.col("_typed").isNull() & ~(is_array | (is_object & (F.array_join(F.map_keys(outer), ",") == envelope))), "root")
        .when(~every, "item")
        .when(F.size("_typed") != expected, "count")
    )
    rows = rows.withColumn("error", error)
    return rows.withColumn("items", F.when(F.col("error").isNull(), F.col("_typed"))).drop("_root", "_typed", "_raw")


def walked(values: DataFrame, ident: str, value: str) -> DataFrame:
    """(ident, path, key, value): every field of every object inside a VARIANT column, at any depth and in any order.

    value is the field's text if it is a plain one, else null; fields of objects inside it are rows of their own.
    path names the way to the object, as keys and [n]. One round opens one level, of all rows at once, and rounds end
    when no row has a level below it, so depth is bound by the data alone and no text is parsed twice.
    """
    spark = values.sparkSession
    level = values.select(F.col(ident).alias("_id"), F.lit("$").alias("path"), F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    out = None
    while True:
        nested = level.where(F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)"))
        opened = nested.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select("_id", "path", "pos", "key", "value", F.schema_of_variant("_v").startswith("OBJECT").alias("_field"))
        opened = opened.where(F.col("value").isNotNull()).checkpoint()
        if not opened.limit(1).count():
            break
        plain = F.when(~F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)"), F.col("value").cast("string"))
        found = opened.where("_field").select(F.col("_id").alias(ident), "path", "key", plain.alias("value"))
        out = found if out is None else out.unionByName(found)
        step = F.when(F.col("_field"), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = opened.select("_id", F.concat("path", step).alias("path"), F.col("value").alias("_v"))
    empty = values.limit(0).select(ident, F.lit("").alias("path"), F.lit("").alias("key"), F.lit("").alias("value"))
    return empty if out is None else out
