"""State machines and progress over the given tables; the SQL says the same by windows and joins of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import progress
from ..session import table
from ..streaming import buffers, conversations

_EVENTS = """
    select e.user_id as conv_id, event_id as seq,
      case event_type when 'signup' then 'stage' when 'error' then 'update' when 'purchase' then 'end' else 'chunk' end as kind,
      case when event_type = 'signup' then null when event_type = 'view' and event_id % 23 <> 0 then concat('t', event_id % 5) else concat('m', e.user_id) end as message_id,
      case event_type when 'signup' then (case event_id % 5 when 0 then 'summarizing_context' when 1 then 'generating_image' when 2 then 'generated_image_ready' when 3 then 'image_generation_failed' else 'other' end)
        when 'click' then props when 'error' then (case when e.user_id % 3 = 0 then 'else' else coalesce(said, '') end) when 'purchase' then (case when e.user_id % 4 = 0 then 'else' else coalesce(said, '') end) end as text,
      case when event_type = 'view' then (case event_id % 4 when 0 then 'recipe_search' when 1 then 'web_search' when 2 then 'lookup' else 'generate_dish_image' end) end as tool
    from {events} e left join said s on s.user_id = e.user_id"""


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as those of an agent: clicks are texts, views are calls of tools, a purchase is the end."""
    events = table(spark, sf_dir, "events")
    ends = events.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("_user")).agg(F.min("event_id").alias("_end"))
    clicks = events.where("event_type = 'click'").join(ends, F.col("user_id") == F.col("_user")).where("event_id < _end")
    said = clicks.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "props"))), lambda x: x["props"]), "").alias("said"))
    rows = spark.sql(_EVENTS.replace("left join said s", "left join {said} s"), events=events, said=said)
    return rows.withColumn("tools", F.when(F.col("tool").isNotNull(), F.array("tool")))


def conversation_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the clients of all users are told."""
    return conversations.told(agent_events(spark, sf_dir))


def buffer_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's buffer of four events for a day: what became of every event."""
    puts = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("item"), "ts")
    return buffers.fates(puts, ttl=86_400, capacity=4)


def incremental_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns to do after a run over the first two of each conversation, in which some had another text."""
    turns = table(spark, sf_dir, "conversations")
    earlier = turns.where("turn <= 1").withColumn("text", F.when(F.expr("conv_id % 7 = 0 and turn = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return progress.pending(turns, progress.advanced(earlier)).select("conv_id", "turn", "restarted")


QUERIES = {"conversation_told": conversation_told, "buffer_fates": buffer_fates, "incremental_pending": incremental_pending}
ORACLES = {
    "conversation_told": """
    WITH said AS (
      SELECT user_id, string_agg(props, '' ORDER BY event_id) AS said FROM events e
      WHERE event_type = 'click' AND event_id < (SELECT min(event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase') GROUP BY user_id
    ), agent AS ("""
    + _EVENTS.replace("{events}", "events")
    + """), flagged AS (
      SELECT *, kind = 'chunk' AND tool IS NOT NULL AS asks, kind = 'chunk' AND tool IS NULL AND coalesce(text, '') <> '' AS writes FROM agent
    ), faulty AS (
      SELECT *, coalesce((asks AND bool_or(writes) OVER m) OR (writes AND bool_or(asks) OVER m), false) AS wrong
      FROM flagged WINDOW m AS (PARTITION BY conv_id, coalesce(message_id, '') ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), cut AS (
      SELECT * FROM (SELECT *, min(CASE WHEN wrong OR kind = 'end' THEN seq END) OVER (PARTITION BY conv_id) AS last FROM faulty) WHERE last IS NULL OR seq <= last
    ), placed AS (
      SELECT *, CASE WHEN row_number() OVER c = 1 THEN 1 ELSE 0 END AS p, coalesce(sum(CASE WHEN writes AND NOT wrong THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS texts,
        CASE tool WHEN 'recipe_search' THEN 'searching_recipe_kb' WHEN 'web_search' THEN 'searching_web' WHEN 'lookup' THEN 'using_tool' END AS status
      FROM cut WINDOW c AS (PARTITION BY conv_id ORDER BY seq)
    ), whole AS (
      SELECT conv_id, string_agg(text, '' ORDER BY seq) AS written, min(message_id) AS w1, max(message_id) AS w2 FROM placed WHERE writes AND NOT wrong GROUP BY conv_id
    ), updated AS (
      SELECT conv_id, arg_max(message_id, seq) AS uid, arg_max(text, seq) AS utext FROM placed WHERE kind = 'update' AND coalesce(text, '') <> '' GROUP BY conv_id
    ), ended AS (
      SELECT e.conv_id, e.seq, e.p, e.texts, e.text, coalesce(written, '') AS written,
        CASE WHEN coalesce(written, '') <> '' AND written <> e.text THEN 'text differs from the final message'
          WHEN w1 IS NOT NULL AND (w1 <> e.message_id OR w2 <> e.message_id) THEN 'text of another message'
          WHEN uid = e.message_id AND utext <> e.text THEN 'update differs from the final message' END AS error
      FROM placed e LEFT JOIN whole USING (conv_id) LEFT JOIN updated USING (conv_id) WHERE e.kind = 'end'
    )
    SELECT conv_id, seq, 0::INT AS part, 'status' AS event, 'thinking' AS value FROM placed WHERE p = 1
    UNION ALL SELECT conv_id, seq, p, 'error', 'text in a tool request' FROM placed WHERE wrong
    UNION ALL SELECT conv_id, seq, p, CASE text WHEN 'generated_image_ready' THEN 'generated_image' WHEN 'image_generation_failed' THEN 'image_error' ELSE 'status' END, text FROM placed WHERE kind = 'stage' AND text <> 'other'
    UNION ALL SELECT conv_id, seq, p, 'status', 'generating_answer' FROM placed WHERE writes AND NOT wrong AND texts = 0
    UNION ALL SELECT conv_id, seq, p + (texts = 0)::INT, 'token', text FROM placed WHERE writes AND NOT wrong
    UNION ALL SELECT conv_id, seq, p, 'status', status FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, status ORDER BY seq) AS nth FROM placed WHERE status IS NOT NULL AND NOT wrong) WHERE nth = 1
    UNION ALL SELECT conv_id, seq, p, 'error', error FROM ended WHERE error IS NOT NULL
    UNION ALL SELECT conv_id, seq, p, 'status', 'generating_answer' FROM ended WHERE error IS NULL AND written = '' AND texts = 0
    UNION ALL SELECT conv_id, seq, p + (texts = 0)::INT, 'token', text FROM ended WHERE error IS NULL AND written = ''
    UNION ALL SELECT conv_id, seq, p + CASE WHEN written = '' THEN 1 + (texts = 0)::INT ELSE 0 END, 'status', 'completed' FROM ended WHERE error IS NULL
    UNION ALL SELECT conv_id, seq, p + 1 + CASE WHEN written = '' THEN 1 + (texts = 0)::INT ELSE 0 END, 'done', NULL FROM ended WHERE error IS NULL""",
    "buffer_fates": """
    SELECT a.user_id AS key, a.event_id AS item, a.ts AS put, CASE WHEN b.ts IS NULL THEN 'expired' ELSE 'evicted' END AS fate, coalesce(b.ts, a.ts + INTERVAL 1 DAY) AS at
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) a
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) b ON b.user_id = a.user_id AND b.n = a.n + 4 AND b.ts <= a.ts + INTERVAL 1 DAY""",
    "incremental_pending": """
    SELECT conv_id, turn, conv_id % 7 = 0 AND first <= 0 AS restarted FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)
    WHERE (conv_id % 7 = 0 AND first <= 0) OR turn > 1""",
}
