"""Replies, raw records, memories and query sets over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import replies
from ..operators import memories, querysets, restructure
from ..session import checkpoints, table


def conversation_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a reply: an array, an envelope, or either with a fault, by the conversation's number."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["turn"].alias("turn"), t["text"].alias("text"))).alias("t"))
    array = F.to_json("t")
    reply = (
        F.when(F.expr("conv_id % 7 = 0"), F.concat(array, F.lit(" that was all")))
        .when(F.expr("conv_id % 7 = 1"), F.concat(F.lit('{"recipes": '), array, F.lit("}")))
        .when(F.expr("conv_id % 7 = 2"), F.concat(F.lit('{"recipes": '), array, F.lit(', "more": 1}')))
        .when(F.expr("conv_id % 7 = 3"), F.regexp_replace(array, '"turn":0', '"turn":"0"'))
        .otherwise(array)
    )
    return rows.select("conv_id", reply.alias("reply"), F.size("t").alias("n"))


def decoded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each reply decodes, three turns more or less being wrong where the number says so."""
    rows = conversation_replies(spark, sf_dir)
    item = spark.createDataFrame([], "role string not null, turn bigint not null, text string").schema
    out = replies.decoded(rows, item, F.col("n") + F.expr("cast(conv_id % 7 = 4 as int)"), "recipes")
    return out.select("conv_id", "error", F.coalesce(F.size("items"), F.lit(0)).alias("items"), F.array_join(F.transform("items", lambda i: i["role"]), ",").alias("roles"))


def walked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each key holds a plain value, and how many letters, over conversations nested three levels deep."""
    checkpoints(spark)
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.struct("role", F.struct("text").alias("content")).alias("message"))).alias("turns"))
    values = turns.select("conv_id", F.parse_json(F.to_json(F.struct(F.col("conv_id").alias("conv"), "turns"))).alias("v"))
    out = replies.walked(values, "conv_id", "v").where("value is not null")
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("letters"), F.count_distinct(F.regexp_replace("path", "[0-9]+", "")).alias("paths"))


def user_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as candidates for memories: what is remembered of each user in the end."""
    events = table(spark, sf_dir, "events")
    rows = events.selectExpr(
        "user_id as owner", "concat(' Key  ', event_id % 5) as key", "event_id as seq", "case when event_type = 'error' then 'DELETE' else 'UPSERT' end as action",
        "case when event_id % 3 = 0 then 'DIETARY_RESTRICTION' else 'FOOD_PREFERENCE' end as kind", "concat('Value ', event_id % 4) as value", "least(1.0D, 0.7 + event_id % 37 / 100.0D) as confidence",
    )
    return memories.remembered(rows)


def raw_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as raw records, whose steps name parts of their own, or of another order; and the vocabulary of part names."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "p_name", "p_brand")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name", "l_discount", "p_brand")
    nested = lines.groupBy(F.col("l_orderkey").alias("record_id")).agg(F.sort_array(F.collect_list(row)).alias("l"))
    name = lambda x: F.when(x["l_partkey"] % 401 == 0, F.concat(F.lit("no such "), x["p_name"])).otherwise(F.upper(F.regexp_replace(x["p_name"], " ", "-")))
    other = lambda x: F.when((x["l_discount"] >= 0.09) & (x["l_partkey"] % 11 == 0), F.lit("red widget")).otherwise(name(x))
    raw = nested.select(
        "record_id", F.transform("l", lambda x: F.struct(name(x).alias("name"), x["p_brand"].alias("unit"))).alias("ingredients"),
        F.transform("l", lambda x, i: F.struct((i + 1).alias("ordinal"), F.array(other(x), other(x)).alias("ingredient_names"))).alias("steps"),
    )
    entries = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("string").alias("id")).withColumn("aliases", F.array(F.concat(F.lit("the "), "name")))
    return raw, entries


def restructured_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order: its ingredients' and steps' ids, or the first fault."""
    checkpoints(spark)
    records, issues = restructure.restructured(*raw_orders(spark, sf_dir))
    ids = F.array_join(F.transform("ingredients", lambda i: i["id"]), ",").alias("ids")
    refs = F.array_join(F.transform("steps", lambda s: F.array_join(s["ingredient_refs"], "+")), ",").alias("refs")
    none = F.lit(None).cast("string")
    return records.select("record_id", ids, refs, none.alias("code"), none.alias("message")).unionByName(issues.select("record_id", none.alias("ids"), none.alias("refs"), "code", "message"))


def query_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty and seventy-five queries of five kinds for parts; many parts share a name, so texts repeat."""
    checkpoints(spark)
    parts = querysets.strided(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    texts = F.array(F.concat(F.lit("what is "), "p_name"), F.upper(F.concat_ws(" ", "p_name", "p_type")), F.concat_ws(" ", F.lit("quick"), "p_name"), F.concat_ws(" ", F.lit("not"), "p_brand"), F.concat_ws(" ", (F.col("p_size") % 20).cast("string"), "p_name"))
    return querysets.query_sets(parts.select("ordinal", F.col("p_partkey").alias("item_id"), texts.alias("texts")), KINDS, 20, 30)


#: Kinds of queries, in the order in which they are dealt.
KINDS = ["ingredient", "synonym", "scenario", "preference", "combined"]

QUERIES = {"query_sets": query_sets, "decoded_replies": decoded_replies, "walked_values": walked_values, "user_memories": user_memories, "restructured_records": restructured_records}
ORACLES = {
    "query_sets": """
    WITH RECURSIVE p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part),
    c AS (
      SELECT row_number() OVER (ORDER BY place % 2, place) AS o, p_partkey,
        ['what is ' || p_name, upper(p_name || ' ' || p_type), 'quick ' || p_name, 'not ' || p_brand, (p_size % 20) || ' ' || p_name] AS t FROM p
    ), f AS (
      SELECT 0::BIGINT AS o, 0 AS n, []::VARCHAR[] AS seen, NULL::VARCHAR AS query, NULL::BIGINT AS item
      UNION ALL
      SELECT c.o, CASE WHEN list_contains(seen, t[n % 5 + 1]) THEN n ELSE n + 1 END, CASE WHEN list_contains(seen, t[n % 5 + 1]) THEN seen ELSE list_append(seen, t[n % 5 + 1]) END,
        CASE WHEN NOT list_contains(seen, t[n % 5 + 1]) THEN t[n % 5 + 1] END, p_partkey FROM f JOIN c ON c.o = f.o + 1 WHERE n < 50
    )
    SELECT CASE WHEN n <= 20 THEN 'dev-' ELSE 'hol-' END || lpad(n::VARCHAR, 3, '0') AS query_id, CASE WHEN n <= 20 THEN 'development' ELSE 'holdout' END AS split, n::INT AS number,
      ['ingredient', 'synonym', 'scenario', 'preference', 'combined'][(n - 1) % 5 + 1] AS kind, query, item AS item_id FROM f WHERE query IS NOT NULL""",
    "decoded_replies": """
    SELECT conv_id, CASE conv_id % 7 WHEN 0 THEN 'json' WHEN 2 THEN 'root' WHEN 3 THEN CASE WHEN bool_or(turn = 0) THEN 'item' END WHEN 4 THEN 'count' END AS error,
      CASE WHEN conv_id % 7 IN (0, 2, 4) OR (conv_id % 7 = 3 AND bool_or(turn = 0)) THEN 0 ELSE count(*) END::INT AS items,
      CASE WHEN conv_id % 7 IN (0, 2, 4) OR (conv_id % 7 = 3 AND bool_or(turn = 0)) THEN NULL ELSE string_agg(role, ',' ORDER BY turn, role, text) END AS roles
    FROM conversations GROUP BY conv_id""",
    "walked_values": """
    SELECT 'conv' AS key, count(DISTINCT conv_id) AS n, (SELECT sum(length(c::VARCHAR)) FROM (SELECT DISTINCT conv_id AS c FROM conversations))::BIGINT AS letters, 1::BIGINT AS paths FROM conversations
    UNION ALL SELECT 'turn', count(turn), sum(length(turn::VARCHAR)), 1 FROM conversations
    UNION ALL SELECT 'role', count(role), sum(length(role)), 1 FROM conversations
    UNION ALL SELECT 'text', count(text), sum(length(text)), 1 FROM conversations""",
    "user_memories": """
    WITH RECURSIVE c AS (
      SELECT user_id AS owner, 'key ' || event_id % 5 AS key, event_id AS seq, event_type = 'error' AS gone, CASE WHEN event_id % 3 = 0 THEN 'DIETARY_RESTRICTION' ELSE 'FOOD_PREFERENCE' END AS kind,
        'Value ' || event_id % 4 AS value, least(1.0::DOUBLE, 0.7::DOUBLE + event_id % 37 / 100.0::DOUBLE) AS confidence, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) AS n FROM events
    ), f AS (
      SELECT owner, key, 0::BIGINT AS n, NULL::VARCHAR AS kind, NULL::VARCHAR AS value, NULL::DOUBLE AS confidence, NULL::BOOLEAN AS active, NULL::BIGINT AS changed FROM c WHERE n = 1
      UNION ALL
      SELECT f.owner, f.key, c.n,
        CASE WHEN keeps THEN f.kind WHEN c.gone THEN f.kind WHEN f.kind = 'DIETARY_RESTRICTION' THEN f.kind ELSE c.kind END,
        CASE WHEN keeps OR c.gone THEN f.value ELSE c.value END,
        CASE WHEN keeps OR c.gone THEN f.confidence WHEN f.kind IS NULL OR f.value <> c.value OR f.kind <> c.kind THEN round(c.confidence, 4) ELSE greatest(f.confidence, round(c.confidence, 4)) END,
        CASE WHEN keeps THEN f.active ELSE NOT c.gone END, CASE WHEN keeps THEN f.changed ELSE c.seq END
      FROM f JOIN c ON c.owner = f.owner AND c.key = f.key AND c.n = f.n + 1,
      LATERAL (SELECT c.confidence < 0.8::DOUBLE OR (c.gone AND (f.kind IS NULL OR NOT f.active)) OR coalesce(f.kind = 'DIETARY_RESTRICTION' AND c.confidence < 0.98::DOUBLE AND (c.gone OR f.value <> c.value OR f.kind <> c.kind), false) AS keeps)
    )
    SELECT owner, key, kind, value, confidence, active, changed FROM f WHERE kind IS NOT NULL QUALIFY n = max(n) OVER (PARTITION BY owner, key)""",
    "restructured_records": """
    WITH v AS (SELECT p_name AS name, min(p_partkey)::VARCHAR AS id FROM part GROUP BY p_name),
    l AS (
      SELECT l_orderkey AS record_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, p_name, l_discount) AS i, p_name, id,
        l_partkey % 401 = 0 AS unknown, l_discount >= 0.09 AND l_partkey % 11 = 0 AS other FROM lineitem JOIN part ON l_partkey = p_partkey JOIN v ON v.name = p_name
    ), known AS (SELECT *, bool_or(p_name = 'red widget' AND NOT unknown) OVER (PARTITION BY record_id) AS has_red, bool_or(unknown) OVER (PARTITION BY record_id) AS bad FROM l),
    faults AS (
      SELECT record_id, arg_min('unknown ingredient: no such ' || p_name, i) FILTER (unknown) AS m1,
        arg_min('step ' || i || ' names an ingredient that the record has not: red widget', i) FILTER (other AND NOT has_red) AS m2,
        string_agg(id, ',' ORDER BY i) AS ids, string_agg(CASE WHEN other THEN (SELECT id FROM v WHERE name = 'red widget') ELSE id END, ',' ORDER BY i) AS refs FROM known GROUP BY record_id
    )
    SELECT record_id, CASE WHEN coalesce(m1, m2) IS NULL THEN ids END AS ids, CASE WHEN coalesce(m1, m2) IS NULL THEN refs END AS refs,
      CASE WHEN coalesce(m1, m2) IS NOT NULL THEN 'RECIPE_TRANSFORM_FAILED' END AS code, coalesce(m1, m2) AS message FROM faults""",
}
