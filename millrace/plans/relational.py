"""Plans that plain SQL says best: counts, rates, filters, joins, windows, samples, versions and integrity over the driver tables.

Each text runs in Spark and, with table names in place of the braces, in any other ANSI engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Documents numbered by doc_id without one task for all rows: within ranges of ids, after the counts of the ranges before.
NUMBERED = """
          select %s, row_number() over (partition by d.id_range order by doc_id) + earlier as rn
          from (select *, cast(floor(doc_id / 4096.0e0) as bigint) as id_range from {documents}) d
          join (select id_range, sum(n) over (order by id_range rows unbounded preceding) - n as earlier from (
            select cast(floor(doc_id / 4096.0e0) as bigint) as id_range, count(*) as n from {documents} group by 1) c) b on d.id_range is not distinct from b.id_range"""

SQL: dict[str, str] = {
    # distributions, rates, percentiles
    "frequency_distribution": """
        select lang, source, count(*) as n, round(count(*) * 1.0e0 / sum(count(*)) over (), 4) as ratio
        from {documents} group by lang, source""",
    "top_overrepresented": """
        select p_brand, n, ratio from (
          select p_brand, count(*) as n, round(count(*) * 1.0e0 / sum(count(*)) over (), 4) as ratio,
                 row_number() over (order by count(*) desc, p_brand) as rn
          from {part} group by p_brand) t where rn <= 20""",
    "concentration_warnings": """
        select dimension, value, round(n * 1.0e0 / total, 4) as share from (
          select 'brand' as dimension, p_brand as value, count(*) as n, sum(count(*)) over () as total, 0.04e0 as least from {part} group by p_brand
          union all
          select 'status', o_orderstatus, count(*), sum(count(*)) over (), 0.35e0 from {orders} group by o_orderstatus) t
        where n * 1.0e0 / total > least""",
    "distinct_counts": """
        select (select count(distinct lower(text)) from {documents}) as texts, (select count(distinct p_brand) from {part}) as brands,
               (select count(distinct lower(p_name)) from {part}) as names""",
    "status_summary": """
        select count(*) as processed, count(case when o_orderstatus = 'F' then 1 end) as accepted, count(case when o_orderstatus = 'O' then 1 end) as open_orders,
               count(case when o_orderstatus = 'P' then 1 end) as needs_review from {orders}""",
    "filtered_counts": """
        select c_mktsegment, count(*) as orders_n, count(*) filter (where o_totalprice > 100000) as large_n, count(distinct o_custkey) as customers_n
        from {orders} join {customer} on o_custkey = c_custkey group by c_mktsegment""",
    "safe_rates": """
        select lang, count(*) as n, count(quality) as labelled, case when count(quality) = 0 then 0.0e0 else round(sum(coalesce(quality, 0)) * 1.0e0 / count(quality), 4) end as quality_rate,
               case when count(toxic) = 0 then 0.0e0 else round(sum(coalesce(toxic, 0)) * 1.0e0 / count(toxic), 4) end as toxic_rate
        from {documents} d left join {labels} l on d.doc_id = l.doc_id group by lang""",
    "latency_percentiles": """
        select event_type, round(avg(value), 4) as mean_value, round(median(value), 4) as p50,
               round(max(case when rn = least(n, cast(floor(n * 0.95e0) as bigint) + 1) then value end), 4) as p95
        from (select event_type, value, row_number() over (partition by event_type order by value) as rn, count(*) over (partition by event_type) as n from {events}) t
        group by event_type""",
    "strategy_rollup": """
        select count(*) as users, count(case when clicks > 0 and purchases > 0 then 1 end) as click_and_purchase, count(case when errors > 0 then 1 end) as with_errors,
               round(avg(case when purchases > 0 then 1.0e0 else 0.0e0 end), 4) as purchase_rate
        from (select user_id, count(case when event_type = 'click' then 1 end) as clicks, count(case when event_type = 'purchase' then 1 end) as purchases,
                     count(case when event_type = 'error' then 1 end) as errors from {events} group by user_id) t""",
    "category_metrics": """
        select first_role, count(*) as conversations_n, round(avg(case when long_turn then 1.0e0 else 0.0e0 end), 4) as long_rate, round(avg(turns * 1.0e0), 4) as mean_turns
        from (select conv_id, max(case when turn = 0 then role end) as first_role, bool_or(length(text) > 400) as long_turn, count(*) as turns from {conversations} group by conv_id) t
        group by first_role""",
    "generation_report": """
        select coalesce(a.k, b.k) as priority, coalesce(a.n, 0) as requested, coalesce(b.n, 0) as accepted
        from (select o_orderpriority as k, count(*) as n from {orders} group by o_orderpriority) a
        full outer join (select o_orderpriority as k, count(*) as n from {orders} where o_orderstatus = 'F' group by o_orderpriority) b on a.k = b.k""",
    "conversation_counts": "select conv_id, count(*) as messages from {conversations} group by conv_id",
    "cube_counts": """
        select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from {lineitem} group by cube (l_returnflag, l_linestatus)""",
    "constraint_audit": """
        select event_type, case when value is null then 'missing' when value < 10 then 'dropped' when value < 50 then 'partial' else 'forwarded' end as status, count(*) as n
        from {events} group by 1, 2""",
    "reliability_phases": """
        select phase, count(distinct user_id) as users, count(distinct case when event_type = 'error' then user_id end) as failed_users,
               round(count(distinct case when event_type = 'error' then user_id end) * 1.0e0 / count(distinct user_id), 4) as failure_rate
        from (select user_id, event_type, cast(floor((extract(day from ts) - 1) / 7) as bigint) as phase from {events}) t group by phase""",
    # filters, semi and anti joins
    "hard_filter_ranges": "select p_partkey, p_brand, p_size from {part} where p_size between 5 and 20 and p_retailprice <= 1200 and p_brand <> 'Brand#11'",
    "not_exists_filter": "select c_custkey from {customer} c where not exists (select 1 from {orders} o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F' and o.o_totalprice > 250000)",
    "not_exists_joined": """
        select s_suppkey from {supplier} s where not exists (
          select 1 from {lineitem} l join {part} p on l.l_partkey = p.p_partkey where l.l_suppkey = s.s_suppkey and p.p_size = 7 and l.l_quantity > 48)""",
    "exists_all_required": """
        select o_orderkey from {orders} o
        where exists (select 1 from {lineitem} l where l.l_orderkey = o.o_orderkey and l.l_returnflag in ('A', 'R'))
          and exists (select 1 from {lineitem} l where l.l_orderkey = o.o_orderkey and l.l_quantity >= 45)""",
    "composite_key_join": """
        select a.l_returnflag as flag, count(*) as n, round(sum(b.l_quantity), 2) as quantity
        from {lineitem} a join {lineitem} b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber group by a.l_returnflag""",
    "double_dim_join": """
        select cn.n_name as customer_nation, sn.n_name as supplier_nation, count(*) as n
        from {customer} c join {nation} cn on c.c_nationkey = cn.n_nationkey join {supplier} s on s.s_suppkey = c.c_custkey join {nation} sn on s.s_nationkey = sn.n_nationkey
        group by cn.n_name, sn.n_name""",
    "orphan_anti_join": """
        select 'order' as parent, count(*) as orphans from {lineitem} l left join (select * from {orders} where o_orderstatus <> 'P') o on l.l_orderkey = o.o_orderkey where o.o_orderkey is null
        union all select 'part', count(*) from {lineitem} l left join (select * from {part} where p_size < 40) p on l.l_partkey = p.p_partkey where p.p_partkey is null""",
    "self_join_inequality": """
        select a.c_custkey as kept, b.c_custkey as other from {customer} a join {customer} b
        on a.c_nationkey = b.c_nationkey and a.c_mktsegment = b.c_mktsegment and a.c_custkey < b.c_custkey and abs(a.c_acctbal - b.c_acctbal) < 20""",
    "blocked_pairs": """
        select a.p_partkey as left_id, b.p_partkey as right_id from {part} a join {part} b
        on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_size = b.p_size and a.p_partkey < b.p_partkey""",
    "name_resolution": """
        select page_id, n_name, case when n_name is null then 'missing' else 'found' end as state
        from (select page_id, cast(page_id % 37 as int) as wanted from {pages}) p left join {nation} on n_nationkey = wanted""",
    "paired_deltas": """
        select custkey, round(late - early, 6) as delta, case when late - early > 0 then 'improved' when late - early < 0 then 'worse' else 'equal' end as decision
        from (select o_custkey as custkey, avg(case when o_orderdate < timestamp '1998-01-01' then o_totalprice end) as early, avg(case when o_orderdate >= timestamp '1998-01-01' then o_totalprice end) as late
              from {orders} group by o_custkey) t where early is not null and late is not null""",
    "symmetric_difference": """
        select 'customer_only' as side, count(*) as n from (select c_custkey from {customer} except select o_custkey from {orders} where o_totalprice > 300000) t
        union all select 'order_only', count(*) from (select o_custkey from {orders} except select c_custkey from {customer} where c_acctbal > 0) t""",
    "alias_resolution": """
        select p_partkey, key, canonical from (
          select p_partkey, regexp_replace(lower(trim(p_name)), '[ _-]+', '') as key, cut.canonical
          from (select p_partkey, p_name, split_part(p_name, ' ', 1) as word from {part}) p
          left join (select 'red' as alias, 'crimson' as canonical union all select 'blue', 'navy' union all select 'green', 'green') cut on p.word = cut.alias) t""",
    "vocabulary_review": """
        select decision, count(*) as n from (
          select case when v.canonical = p.word then 'APPROVE' when v.canonical is not null then 'MAP' else 'REVIEW' end as decision
          from (select split_part(p_name, ' ', 1) as word from {part}) p
          left join (select 'red' as alias, 'crimson' as canonical union all select 'blue', 'navy' union all select 'green', 'green') v on p.word = v.alias) t group by decision""",
    # quality rules, scores, gates
    "validation_issues": """
        select record, line, issue.code, issue.severity from (
          select l_orderkey as record, l_linenumber as line, explode(array(
            case when l_discount > 0.09 then struct('DISCOUNT_IMPLAUSIBLE' as code, 'ERROR' as severity) end,
            case when l_quantity > 49 then struct('QUANTITY_LARGE' as code, 'WARNING' as severity) end,
            case when l_shipdate < o_orderdate then struct('SHIPPED_BEFORE_ORDER' as code, 'ERROR' as severity) end)) as issue
          from {lineitem} left join {orders} on l_orderkey = o_orderkey) t
        where issue is not null""",
    "quality_gate": """
        select doc_id, score, case when errors > 0 or score < 0.70 then 'REJECTED' when score < 0.85 then 'REVIEW' else 'PUBLISHED' end as status from (
          select d.doc_id, case when coalesce(l.toxic, 0) = 1 then 1 else 0 end as errors,
                 round(0.30 * greatest(0.0e0, 1 - 0.5 * coalesce(l.toxic, 0)) + 0.15 * (case when n_chars >= 200 then 1.0e0 else 0.5e0 end)
                     + 0.20 * (case when text like '%http%' then 0.85e0 else 1.0e0 end) + 0.20 * (0.8 + 0.2 * ((case when lang is not null then 1 else 0 end + case when source is not null then 1 else 0 end) / 2.0e0))
                     + 0.15 * coalesce(l.quality, 0) * 1.0e0, 4) as score
          from {documents} d left join {labels} l on d.doc_id = l.doc_id) t""",
    "issue_class_counts": """
        select class, count(*) as n from (
          select case when n_chars < 100 then 'TOO_SHORT' when n_chars > 20000 then 'TOO_LONG' when text like '%@%' then 'PERSONAL_DATA' when text like '%http%' then 'LINK' else 'AUDIT_PASSED' end as class from {documents}) t
        group by class""",
    "sequence_check": """
        select conv_id, case when min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*) then 'OK' else 'STEP_ORDER_INVALID' end as state from {conversations} group by conv_id""",
    "integrity_report": """
        select (select count(*) from {orders}) as orders_n, (select count(*) from {lineitem}) as lines_n, (select count(*) from {customer}) as customers_n,
               (select count(*) from (select o_orderkey from {orders} group by o_orderkey having count(*) > 1) t) as duplicate_orders,
               (select count(*) from {orders} o left join {customer} c on o.o_custkey = c.c_custkey where c.c_custkey is null) as orphan_orders,
               (select count(*) from {orders} o left join (select l_orderkey, count(*) as n from {lineitem} group by l_orderkey) l on o.o_orderkey = l.l_orderkey where coalesce(l.n, 0) <> 4) as orders_not_of_four""",
    # ranks, pages, samples, splits
    "recent_n": "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as rn from {conversations}) t where rn <= 8",
    "after_last_user": """
        select conv_id, turn, role from (select *, max(case when role = 'user' then turn end) over (partition by conv_id) as last_user from {conversations}) t where turn > last_user""",
    "token_budget_suffix": """
        select conv_id, turn from (
          select *, max(case when role = 'user' and turn <= cutoff then turn end) over (partition by conv_id) as user_cut from (
            select *, min(case when total <= 400 or newest = 1 then turn end) over (partition by conv_id) as cutoff from (
              select conv_id, turn, role, sum(length(text)) over (partition by conv_id order by turn desc rows unbounded preceding) as total,
                     row_number() over (partition by conv_id order by turn desc) as newest, count(*) over (partition by conv_id) as many from {conversations}) a) b) c
        where many < 2 or turn >= coalesce(user_cut, cutoff)""",
    "pagination": """
        select o_orderkey, total, total_pages from (
          select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey desc) as rn, (select count(*) from {orders}) as total,
                 (select cast(ceil(count(*) / 20.0e0) as bigint) from {orders}) as total_pages
          from (select o_orderkey, o_orderdate from {orders} order by o_orderdate desc, o_orderkey desc limit 60) newest) t
        where rn between 41 and 60""",
    "preferred_row": """
        select user_id, event_type, event_id from (
          select *, row_number() over (partition by user_id, event_type order by case when value > 50 then 0 else 1 end, value desc, ts desc, event_id) as rn from {events}) t where rn = 1""",
    "round_robin_sample": """
        select doc_id, lang from (select doc_id, lang, row_number() over (order by rn, lang) as place from (
          select doc_id, lang, row_number() over (partition by lang order by doc_id) as rn from {documents}) a where rn <= 40) b where place <= 40""",
    "priority_sample": """
        select doc_id, min(priority) as priority from (
          select doc_id, 1 as priority from (select d.doc_id from {documents} d join {labels} l on d.doc_id = l.doc_id order by quality nulls last, d.doc_id limit 10) a
          union all select doc_id, 2 from {labels} where toxic = 1
          union all select doc_id, 3 from (select doc_id from {documents} order by n_chars desc nulls last, doc_id limit 20) b) t group by doc_id""",
    "holdout_split": """
        select doc_id, case when (rn - 1) % 5 = 1 then 'development' else 'holdout' end as split,
               case when rn % 2 = 1 then cast((rn + 1) / 2 as bigint) else (select cast(ceil(count(*) / 2.0e0) as bigint) from {documents}) + cast(rn / 2 as bigint) end as place
        from (""" + NUMBERED.replace("%s", "doc_id") + """) t""",
    "latest_row": "select user_id, max(event_id) as event_id from {events} e where ts = (select max(ts) from {events} f where f.user_id = e.user_id) group by user_id",
    # events
    "trace_rollup": """
        select user_id, cast(ts as date) as day, count(*) as chunks, round(sum(value), 2) as total, max(case when event_type = 'purchase' then 1 else 0 end) as saw_purchase,
               row_number() over (partition by user_id order by cast(ts as date)) as seq
        from {events} group by user_id, cast(ts as date)""",
    "ttl_buffer": """
        select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn, ts from {events}) t
        where rn = 1 and ts > (select max(ts) from {events}) - interval '1' day""",
    "stream_state": """
        select user_id, count(*) as applied, max(case when event_type = 'purchase' then 1 else 0 end) as terminal
        from (select *, min(case when event_type = 'purchase' then event_id end) over (partition by user_id) as final_id from {events}) t
        where final_id is null or event_id <= final_id group by user_id""",
    "memory_merge": """
        select user_id, event_type, event_id, case when value >= 80 then 'kept' else 'weak' end as state from (
          select *, row_number() over (partition by user_id, event_type order by case when value >= 80 then 0 else 1 end, event_id desc) as rn from {events} where value >= 20) t where rn = 1""",
    "import_state": """
        select state, count(*) as n from (
          select case when o.o_orderkey is null then 'inserted' when n.o_orderkey is null then 'removed' when md5(o.body) = md5(n.body) then 'unchanged' else 'updated' end as state
          from (select o_orderkey, concat_ws('|', o_orderstatus, o_orderpriority) as body from {orders} where o_orderkey % 10 <> 3) o
          full outer join (select o_orderkey, concat_ws('|', case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end, o_orderpriority) as body from {orders} where o_orderkey % 10 <> 4) n on o.o_orderkey = n.o_orderkey) t
        group by state""",
    "null_out_deleted": """
        select o_orderkey, case when c_custkey is null or c_acctbal < 0 then null else o_custkey end as o_custkey from {orders} left join {customer} on o_custkey = c_custkey""",
}

#: The same questions as one would ask them of a single node; other engines run these as the check.
PLAIN: dict[str, str] = {
    "validation_issues": """
        select l_orderkey as record, l_linenumber as line, code, severity from (
          select l_orderkey, l_linenumber, case when l_discount > 0.09 then 'DISCOUNT_IMPLAUSIBLE' end as code, 'ERROR' as severity from {lineitem}
          union all select l_orderkey, l_linenumber, case when l_quantity > 49 then 'QUANTITY_LARGE' end, 'WARNING' from {lineitem}
          union all select l_orderkey, l_linenumber, case when l_shipdate < o_orderdate then 'SHIPPED_BEFORE_ORDER' end, 'ERROR' from {lineitem} join {orders} on l_orderkey = o_orderkey) t
        where code is not null""",
    "pagination": """
        select o_orderkey, total, total_pages from (
          select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey desc) as rn, count(*) over () as total, cast(ceil(count(*) over () / 20.0e0) as bigint) as total_pages from {orders}) t
        where rn between 41 and 60""",
    "round_robin_sample": """
        select doc_id, lang from (select doc_id, lang, row_number() over (order by rn, lang) as place from (
          select doc_id, lang, row_number() over (partition by lang order by doc_id) as rn from {documents}) a) b where place <= 40""",
    "priority_sample": """
        select doc_id, min(priority) as priority from (
          select doc_id, 1 as priority from (select d.doc_id, row_number() over (order by quality, d.doc_id) as rn from {documents} d join {labels} l on d.doc_id = l.doc_id) a where rn <= 10
          union all select doc_id, 2 from {labels} where toxic = 1
          union all select doc_id, 3 from (select doc_id, row_number() over (order by n_chars desc, doc_id) as rn from {documents}) b where rn <= 20) t group by doc_id""",
    "holdout_split": """
        select doc_id, case when (rn - 1) % 5 = 1 then 'development' else 'holdout' end as split, row_number() over (order by (rn - 1) % 2, rn) as place
        from (select doc_id, row_number() over (order by doc_id) as rn from {documents}) t""",
    "ttl_buffer": """
        select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn, ts, max(ts) over () as now_ts from {events}) t
        where rn = 1 and ts > now_ts - interval '1' day""",
}

_NAME = re.compile(r"\{(\w+)\}")


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{name: table(spark, sf_dir, name) for name in set(_NAME.findall(text))})

    return run


def self_join_inequality(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one nation and segment whose balances differ by less than 20: they meet only where their balances are in neighbouring bins."""
    # wider than 20, so that a rounded quotient moves no pair further than one bin
    at = F.floor(F.col("c_acctbal").cast("double") / 21)
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", at.alias("_bin"))
    near = c.withColumn("_bin", F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)))
    met = c.alias("a").join(near.alias("b"), ["c_nationkey", "c_mktsegment", "_bin"]).where("a.c_custkey < b.c_custkey and abs(a.c_acctbal - b.c_acctbal) < 20")
    return met.select(F.col("a.c_custkey").alias("kept"), F.col("b.c_custkey").alias("other"))


QUERIES = {name: sql_query(text) for name, text in SQL.items()} | {"self_join_inequality": self_join_inequality}
ORACLES = {name: _NAME.sub(r"\1", text) for name, text in (SQL | PLAIN).items()}
