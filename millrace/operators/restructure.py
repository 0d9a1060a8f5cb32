"""Raw records to nested ones: names resolved by a controlled vocabulary, steps by the record's own ingredients, the rest rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Fixed value: the code of a record that cannot be restructured.
FAILED = "RECIPE_TRANSFORM_FAILED"


def vocabulary(entries: DataFrame) -> DataFrame:
    """(key, id, name) of entries (id, name, aliases): every lookup key of a name and its aliases. A key of several ids names none."""
    keys = entries.select("id", "name", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias"))
    keys = keys.select(text.lookup_key(F.col("alias")).alias("key"), "id", "name").where("key <> ''").distinct()
    return keys.groupBy("key").agg(F.min("id").alias("id"), F.min_by("name", "id").alias("name"), F.count_distinct("id").alias("ids")).where("ids = 1").drop("ids")


def restructured(raw: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, issues) of raw records; every row of raw comes out in just one of them.

    raw: record_id, ingredients (array of struct with a name and more) and steps (array of struct with ordinal,
    ingredient_names and more); other columns stay. Ingredients get id and normalized_name from the vocabulary, and
    keep their fields; steps get ingredient_refs instead of ingredient_names, each id once, in order. A name that the
    vocabulary lacks, or a step that names an ingredient which the record has not, is never guessed: the row becomes an
    issue (record_id, code, message, path) with the first fault in order, ingredients before steps. Null arrays are
    empty; rows of one record_id are rows of their own.
    """
    rows = raw.withColumn("ingredients", F.coalesce("ingredients", _empty(raw, "ingredients")))
    rows = rows.withColumn("steps", F.coalesce("steps", _empty(raw, "steps"))).withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    none = F.array().cast("array<string>")
    said = F.array_distinct(F.concat(F.transform("ingredients", lambda i: i["name"]), F.flatten(F.transform("steps", lambda s: F.coalesce(s["ingredient_names"], none)))))
    asked = rows.select("_row", F.explode(F.array_distinct(F.transform(said, lambda n: F.coalesce(text.lookup_key(n), F.lit(""))))).alias("key"))
    found = asked.join(vocabulary(entries), "key").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("id", "name")))).alias("_known"))
    at = rows.join(found, "_row", "left")
    resolve = lambda n: F.element_at("_known", F.coalesce(text.lookup_key(n), F.lit("")))
    ids = F.transform("ingredients", lambda i: resolve(i["name"])["id"])
    at = at.withColumn("_ids", ids)
    shown = lambda c: F.coalesce(c, F.lit("null"))
    unknown = F.transform(F.filter("ingredients", lambda i: resolve(i["name"]).isNull()), lambda i: F.struct(F.concat(F.lit("unknown ingredient: "), shown(i["name"])).alias("message"), F.lit("ingredients").alias("path")))
    fault = lambda s, n: F.when(resolve(n).isNull(), F.concat(F.lit("unknown ingredient: "), shown(n))).when(~F.array_contains("_ids", resolve(n)["id"]), F.concat(F.lit("step "), s["ordinal"].cast("string"), F.lit(" names an ingredient that the record has not: "), n))
    outside = F.flatten(F.transform("steps", lambda s: F.transform(F.filter(F.coalesce(s["ingredient_names"], none), lambda n: fault(s, n).isNotNull()), lambda n: F.struct(fault(s, n).alias("message"), F.lit("steps").alias("path")))))
    at = at.withColumn("_fault", F.get(F.concat(unknown, outside), F.lit(0)))
    issues = at.where("_fault is not null").select("record_id", F.lit(FAILED).alias("code"), F.col("_fault.message").alias("message"), F.col("_fault.path").alias("path"))
    nested = F.transform("ingredients", lambda i: i.withField("id", resolve(i["name"])["id"]).withField("normalized_name", resolve(i["name"])["name"]))
    refs = lambda s: F.array_distinct(F.transform(F.coalesce(s["ingredient_names"], none), lambda n: resolve(n)["id"]))
    steps = F.transform("steps", lambda s: s.withField("ingredient_refs", refs(s)).dropFields("ingredient_names"))
    records = at.where("_fault is null").withColumn("steps", steps).withColumn("ingredients", nested).drop("_row", "_known", "_ids", "_fault")
    return records, issues


def _empty(raw: DataFrame, column: str) -> Column:
    return F.array().cast(raw.schema[column].dataType)
