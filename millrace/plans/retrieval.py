"""Plans over documents, vectors, pages and conversations, built from the operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import similarity, vectors
from ..session import checkpoints, table
from ..streaming import states


def _queries(emb: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 100."""
    return emb.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    return vectors.nearest(emb, _queries(emb), 5)


def _slice(emb: DataFrame, lane: int) -> DataFrame:
    """A lane's values: 21 each, the last lane's 22."""
    return emb.withColumn("embedding", F.slice("embedding", 21 * lane + 1, 22 if lane == 2 else 21))


def _half(emb: DataFrame, lane: int) -> DataFrame:
    """The first or the last 32 values."""
    return emb.withColumn("embedding", F.slice("embedding", 32 * lane + 1, 32))


#: Into how many tasks' worth the parts of one brand and name are cut.
CHUNKS = 8
#: Candidates of each lane, and the lanes' weights.
LANE_K = 30
LANE_WEIGHTS = (0.45, 0.25, 0.30)


def multi_lane_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best 5 of the union of three lanes' best 30, every one scored in all lanes; rank 31 where a lane lacks the item."""
    emb = table(spark, d, "embeddings")
    lanes = range(len(LANE_WEIGHTS))
    queries = [_queries(_slice(emb, i)) for i in lanes]
    found = [vectors.nearest(_slice(emb, i), queries[i], LANE_K).select("query_id", "item_id", F.col("rank").alias(f"rank{i}")) for i in lanes]
    union = found[0]
    for lane in found[1:]:
        union = union.join(lane, ["query_id", "item_id"], "full_outer")
    for i in lanes:
        items = _slice(emb, i).select(F.col("vec_id").alias("item_id"), F.col("embedding").alias(f"v{i}"))
        union = union.join(items, "item_id").join(queries[i].withColumnRenamed("query_vector", f"q{i}"), "query_id")
        union = union.withColumn(f"s{i}", F.round(vectors.cosine(F.col(f"v{i}"), F.col(f"q{i}")), 6)).drop(f"v{i}", f"q{i}")
    score = F.round(sum((F.col(f"s{i}") * w for i, w in enumerate(LANE_WEIGHTS)), F.lit(0.0)), 5)
    ranks = (F.coalesce(F.col(f"rank{i}"), F.lit(LANE_K + 1)).alias(f"rank{i}") for i in lanes)
    return vectors.top_k(union.select("query_id", "item_id", *ranks, score.alias("score")), "query_id", "item_id", "score", 5)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    lanes = [vectors.nearest(_half(emb, i), _queries(_half(emb, i)), 30) for i in range(2)]
    return vectors.top_k(vectors.fuse([(lanes[0], 10.0), (lanes[1], 1.0)]), "query_id", "item_id", "score", 5)


def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    """By label: mean recall of equal labels in the best 5, and mean reciprocal rank of the first."""
    emb = table(spark, d, "embeddings")
    labels = emb.select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_label"))
    queries = emb.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "label")
    expected = emb.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("expected"))
    hits = cosine_topk(spark, d).join(labels, "item_id").join(queries, "query_id").withColumn("hit", F.col("item_label") == F.col("label"))
    per = hits.groupBy("query_id", "label").agg(F.count_if("hit").alias("found"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first")).join(expected, "label")
    recall = F.when(F.col("expected") == 0, 0.0).otherwise(F.col("found") / F.col("expected"))
    return per.groupBy("label").agg(F.count(F.lit(1)).alias("queries_n"), F.round(F.avg(recall), 4).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


def failure_ladder(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    labels = emb.select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_label"))
    queries = emb.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "label")
    per = cosine_topk(spark, d).join(labels, "item_id").join(queries, "query_id").groupBy("query_id").agg(F.max("score").alias("best"), F.min(F.when(F.col("item_label") == F.col("label"), F.col("rank"))).alias("first"))
    kind = F.when(F.col("best") < 0.2, "NO_CANDIDATE").when(F.col("first").isNull(), "WRONG_LABEL").when(F.col("first") > 1, "RANKED_LOW").otherwise("OK")
    return per.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def coverage_policy(spark: SparkSession, d: str) -> DataFrame:
    per = cosine_topk(spark, d).groupBy("query_id").agg(F.max("score").alias("best"), F.count_if(F.col("score") >= 0.5).alias("good"))
    reason = F.when(F.col("best") < 0.5, "LOW_SEMANTIC").when(F.col("good") < 2, "LOW_COVERAGE").otherwise("SUFFICIENT")
    return per.select("query_id", reason.alias("reason"), (reason == "SUFFICIENT").alias("sufficient"))


def vector_integrity(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    rule = F.when(F.size(v) != 64, "DIMENSION").when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "NOT_FINITE").when(vectors.norm(v) == 0, "ZERO_NORM").otherwise("OK")
    return table(spark, d, "embeddings").groupBy(rule.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def tfidf_search(spark: SparkSession, d: str) -> DataFrame:
    """Best 3 documents of each benchmark text."""
    tokens = lambda df, key: df.select(key, F.explode(tx.tokens(F.col("text"))).alias("term"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    weights, idf = vectors.tfidf(tokens(table(spark, d, "documents").repartition(width), "doc_id"))
    asked = tokens(table(spark, d, "benchmark"), "item_id").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf")).join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    size = asked.groupBy("item_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("size"))
    asked = asked.join(size, "item_id").select(F.col("item_id").alias("query_id"), "term", (F.col("raw") / F.col("size")).alias("q"))
    scored = weights.join(asked, "term").groupBy("query_id", F.col("doc_id").alias("item_id")).agg(F.round(F.sum(F.col("w") * F.col("q")), 6).alias("score"))
    return vectors.top_k(scored, "query_id", "item_id", "score", 3)


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2(tx.compact(F.col("text")), 256).alias("key"))
    firsts = docs.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    return docs.join(firsts, "key").where("doc_id <> first_id").select("doc_id", "first_id")


def near_duplicate_review(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one brand whose name tokens are alike, with the review decision."""
    ratio = F.round(1 - F.levenshtein("l", "r") / F.greatest(F.length("l"), F.length("r")), 4)
    decision = F.when((F.col("l") == F.col("r")) | ((F.col("similarity") >= 0.8) & (F.col("name_ratio") >= 0.55)), "REJECT_RIGHT").otherwise("HUMAN_REVIEW")
    return part_pairs(spark, d, lambda names: names.withColumn("name_ratio", ratio).withColumn("decision", decision))


def part_pairs(spark: SparkSession, d: str, judged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(left_id, right_id, similarity, ..): every pair of parts of one brand whose name tokens are alike by 0.5.

    judged adds columns to the pairs of names (l and r, the left and the right part's). Names are compared once a
    brand, and the parts put in at the end: what is shuffled are parts and, for each part, its alike names. A part
    meets the parts of a name in CHUNKS, so that no task has all pairs of a common name.
    """
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_name").where("p_brand is not null")
    kinds = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("id")).withColumn("elements", F.array_distinct(F.split(F.lower("p_name"), " ")))
    pairs = similarity.set_pairs(kinds.where("p_name is not null"), ["p_brand"], 0.5)
    name = lambda c, to: kinds.select(F.col("id").alias(c), F.col("p_name").alias(to), *(["p_brand"] if to == "l" else []))
    named = pairs.join(name("left_id", "l"), "left_id").join(name("right_id", "r"), "right_id").select("p_brand", "l", "r", "similarity")
    # either of two names may have the left part, and a name is like itself
    turned = named.select("p_brand", F.col("r").alias("l"), F.col("l").alias("r"), "similarity")
    own = kinds.where("p_name is not null").select("p_brand", F.col("p_name").alias("l"), F.col("p_name").alias("r"), F.lit(1.0).alias("similarity"))
    alike = judged(named.unionByName(turned).unionByName(own))
    chunk = F.pmod(F.xxhash64("p_partkey"), F.lit(CHUNKS)).cast("int")
    left = part.select("p_brand", F.col("p_name").alias("l"), F.col("p_partkey").alias("left_id"))
    right = part.select("p_brand", F.col("p_name").alias("r"), F.col("p_partkey").alias("right_id"), chunk.alias("chunk"))
    met = left.join(alike, ["p_brand", "l"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))))
    out = met.join(right.hint("merge"), ["p_brand", "r", "chunk"]).where("left_id < right_id")
    return out.select("left_id", "right_id", *(c for c in alike.columns if c not in ("p_brand", "l", "r")))


def duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    checkpoints(spark)
    links = exact_duplicates(spark, d).select(F.col("first_id").alias("a"), F.col("doc_id").alias("b"))
    return similarity.clusters(links, "a", "b")


def token_sets(spark: SparkSession, d: str) -> DataFrame:
    stop = F.array(*(F.lit(w) for w in ("the", "of", "and", "to", "in", "a")))
    t = tx.latin_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_except(t, stop)).alias("n_terms"))


def title_generation(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", tx.title(F.col("text")).alias("title"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("fingerprint"))


def clause_safety(spark: SparkSession, d: str) -> DataFrame:
    flagged = tx.unsafe_clause(F.col("text"), "the", "and|und|et")
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(flagged).alias("unsafe"), F.count(F.lit(1)).alias("n"))


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("present"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("text_chars"))


def nested_assembly(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c"))
    listed = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce(listed, F.lit("")).alias("lines"))


def array_overlap_filter(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    a = lambda *v: F.array(*(F.lit(x) for x in v))
    return flags.where(~F.arrays_overlap("f", a("R")) & (F.size(F.array_except("f", a("A", "N"))) == 0)).select("l_orderkey", F.size("f").alias("n_flags"))


def history_selection(spark: SparkSession, d: str) -> DataFrame:
    """Turns under a budget of 600 characters: the first user turn, then the newest; the last one is cut."""
    conv = table(spark, d, "conversations")
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    order = Window.partitionBy("conv_id").orderBy(F.when(F.col("turn") == F.col("first"), 0).otherwise(1), F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    used = conv.withColumn("first", first).withColumn("before", F.coalesce(F.sum(F.length("text")).over(order), F.lit(0)))
    return used.where("before < 600").select("conv_id", "turn", F.least(F.length("text").cast("long"), 600 - F.col("before")).alias("kept_chars"))


def latency_marks(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(seconds).alias("at"))
    return first.select("user_id", "event_type", F.round(F.col("at") - F.min("at").over(Window.partitionBy("user_id")), 3).alias("seconds_after"))


def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return states.tumbling(table(spark, d, "events"))


def session_counts(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


_COS = """nearest as (select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) as rank from (
  select q.vec_id as query_id, e.vec_id as item_id, round(list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))), 6) as score
  from base e join base q on q.vec_id % 100 = 0 and e.vec_id <> q.vec_id) t)"""
_BASE = "with base as (select vec_id, label, embedding::double[] as v from embeddings), " + _COS
_LANE = "lane{i} as (select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) as rank from (select q.vec_id as query_id, e.vec_id as item_id, round(list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))), 6) as score from (select vec_id, embedding[{a}:{b}]::double[] as v from embeddings) e join (select vec_id, embedding[{a}:{b}]::double[] as v from embeddings) q on q.vec_id % 100 = 0 and e.vec_id <> q.vec_id) t)"
_LANES = "with " + ", ".join(_LANE.format(i=i, a=21 * i + 1, b=21 * i + 21 + (i == 2)) for i in range(3))
_HALVES = "with " + ", ".join(_LANE.format(i=i, a=32 * i + 1, b=32 * i + 32) for i in range(2))
_PER = "per as (select n.query_id, b.label, max(score) as best, count(case when e.label = b.label then 1 end) as found, min(case when e.label = b.label then rank end) as first from nearest n join base b on b.vec_id = n.query_id join base e on e.vec_id = n.item_id where rank <= 5 group by 1, 2)"
_TOK = "select {k}, unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) as term from {t}"

ORACLES = {
    "cosine_topk": _BASE + " select * from nearest where rank <= 5",
    "multi_lane_topk": _LANES + """, met as (select query_id, item_id from lane0 where rank <= 30 union select query_id, item_id from lane1 where rank <= 30 union select query_id, item_id from lane2 where rank <= 30),
        placed as (select query_id, item_id, least(lane0.rank, 31) as rank0, least(lane1.rank, 31) as rank1, least(lane2.rank, 31) as rank2, round(0.45 * lane0.score + 0.25 * lane1.score + 0.30 * lane2.score, 5) as score
          from met join lane0 using (query_id, item_id) join lane1 using (query_id, item_id) join lane2 using (query_id, item_id))
        select * from (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from placed) u where rank <= 5""",
    "rrf_fusion": _HALVES + """ select * from (select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) as rank from (
        select query_id, item_id, round(sum(part), 8) as score from (select query_id, item_id, 10.0e0 / (60 + rank) as part from lane0 where rank <= 30 union all select query_id, item_id, 1.0e0 / (60 + rank) from lane1 where rank <= 30) p group by 1, 2) t) u where rank <= 5""",
    "recall_mrr": _BASE + ", " + _PER + """ select label, count(*) as queries_n, round(avg(case when expected = 0 then 0.0e0 else found::double / expected end), 4) as recall, round(avg(coalesce(1.0e0 / first, 0)), 4) as mrr
        from per join (select label, count(*) - 1 as expected from base group by label) x using (label) group by label""",
    "failure_ladder": _BASE + ", " + _PER + " select case when best < 0.2 then 'NO_CANDIDATE' when first is null then 'WRONG_LABEL' when first > 1 then 'RANKED_LOW' else 'OK' end as class, count(*) as n from per group by 1",
    "coverage_policy": _BASE + """ select query_id, reason, reason = 'SUFFICIENT' as sufficient from (select query_id, case when max(score) < 0.5 then 'LOW_SEMANTIC' when count(case when score >= 0.5 then 1 end) < 2 then 'LOW_COVERAGE' else 'SUFFICIENT' end as reason
        from nearest where rank <= 5 group by query_id) t""",
    "vector_integrity": "select case when len(embedding) <> 64 then 'DIMENSION' when list_dot_product(embedding::double[], embedding::double[]) = 0 then 'ZERO_NORM' else 'OK' end as state, count(*) as n from embeddings group by 1",
    "tfidf_search": f"""with tok as ({_TOK.format(k='doc_id', t='documents')}), counts as (select doc_id, term, count(*) as tf from tok group by 1, 2),
        idf as (select term, ln((1.0e0 + (select count(distinct doc_id) from tok)) / (1 + count(*))) + 1 as idf from counts group by term),
        raw as (select doc_id, term, tf * idf as raw from counts join idf using (term)), w as (select doc_id, term, raw / sqrt(sum(raw * raw) over (partition by doc_id)) as w from raw),
        qt as ({_TOK.format(k='item_id', t='benchmark')}), qraw as (select item_id, term, tf * idf as raw from (select item_id, term, count(*) as tf from qt group by 1, 2) c join idf using (term)),
        q as (select item_id, term, raw / sqrt(sum(raw * raw) over (partition by item_id)) as q from qraw)
        select query_id, item_id, score, rank from (select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) as rank from (
          select q.item_id as query_id, w.doc_id as item_id, round(sum(w * q), 6) as score from w join q using (term) group by 1, 2) s) t where rank <= 3""",
    "exact_duplicates": "select doc_id, first_id from (select doc_id, min(doc_id) over (partition by sha256(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g'))) as first_id from documents) t where doc_id <> first_id",
    "near_duplicate_review": """with s as (select p_partkey as id, p_brand, p_name, list_distinct(string_split(lower(p_name), ' ')) as e from part)
        select left_id, right_id, similarity, name_ratio, case when l = r or (similarity >= 0.8 and name_ratio >= 0.55) then 'REJECT_RIGHT' else 'HUMAN_REVIEW' end as decision from (
          select a.id as left_id, b.id as right_id, a.p_name as l, b.p_name as r, round(len(list_intersect(a.e, b.e)) * 1.0e0 / len(list_distinct(list_concat(a.e, b.e))), 6) as similarity,
                 round(1 - levenshtein(a.p_name, b.p_name) * 1.0e0 / greatest(length(a.p_name), length(b.p_name)), 4) as name_ratio
          from s a join s b on a.p_brand = b.p_brand and a.id < b.id) t where similarity >= 0.5""",
    "duplicate_clusters": """with k as (select doc_id, min(doc_id) over w as root, count(*) over w as n from documents window w as (partition by sha256(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g'))))
        select doc_id as node, root from k where n > 1""",
    "token_sets": """select doc_id, len(t)::int as n_tokens, len(list_distinct(list_filter(t, lambda x: x not in ('the', 'of', 'and', 'to', 'in', 'a'))))::int as n_terms from (select doc_id, regexp_extract_all(lower(text), '([a-z0-9_]+)', 1) as t from documents) s""",
    "title_generation": """select conv_id, case when length(t) > 60 then substring(t, 1, 59) || '…' else t end as title from (select conv_id, trim(regexp_replace(arg_min(text, turn), '\\s+', ' ', 'g')) as t from conversations where role = 'user' group by conv_id) s""",
    "fingerprints": "select doc_id, substring(sha256(text), 1, 12) as fingerprint from documents",
    "clause_safety": """select lang, count(case when len(list_filter(regexp_split_to_array(text, '[。!?.！？;；\\n]'), lambda x: contains(lower(x), 'the') and not regexp_matches(lower(x), 'and|und|et'))) > 0 then 1 end) as unsafe, count(*) as n from documents group by lang""",
    "json_fields": "select event_type, sum((props->>'$.k')::bigint)::bigint as total, count(props->>'$.k') as present from events group by event_type",
    "html_text": "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, length(regexp_replace(html, '<[^>]*>', '', 'g')) as text_chars from pages",
    "nested_assembly": "select o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey), '') as lines from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey",
    "array_overlap_filter": "select l_orderkey, count(distinct l_returnflag)::int as n_flags from lineitem group by l_orderkey having count(case when l_returnflag = 'R' then 1 end) = 0 and count(case when l_returnflag not in ('A', 'N') then 1 end) = 0",
    "history_selection": """select conv_id, turn, least(length(text), 600 - before)::bigint as kept_chars from (
        select *, coalesce(sum(length(text)) over (partition by conv_id order by case when turn = first then 0 else 1 end, turn desc rows between unbounded preceding and 1 preceding), 0)::bigint as before
        from (select *, min(case when role = 'user' then turn end) over (partition by conv_id) as first from conversations) a) b where before < 600""",
    "latency_marks": "select user_id, event_type, round(epoch_us(began) / 1e6 - min(epoch_us(began) / 1e6) over (partition by user_id), 3) as seconds_after from (select user_id, event_type, min(ts) as began from events group by 1, 2) t",
    "tumbling_counts": "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
    "session_counts": """select user_id, count(*) as sessions, max(n) as longest from (select user_id, session, count(*) as n from (select user_id, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from (
        select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 2 hour or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as fresh from events) a) b group by 1, 2) c group by user_id""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
