"""Scores, explanations and failure classes of ranked items. All are native columns over query-and-item rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(a: Column, b: Column) -> Column:
    """The part of b that a has; 0 where b is empty."""
    return F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.size(b)).otherwise(0.0)


def rule_score(c: dict[str, Column]) -> Column:
    """The rule lane's score.

    c: item_parts, query_parts, item_scenarios, query_scenarios, item_terms, query_terms, dish_terms (arrays); item_name,
    query_text, minutes, max_minutes, preference (0 to 1 or null), quality.
    """
    coverage = share(c["item_parts"], c["query_parts"])
    name = F.regexp_replace(F.lower(c["item_name"]), r"[^\p{L}\p{N}_]+", "")
    said = F.regexp_replace(F.lower(c["query_text"]), r"[^\p{L}\p{N}_]+", "")
    spare = c["max_minutes"] - c["minutes"]
    time = F.when(spare >= 0, 3.0 + spare / 30).when(spare < 0, -F.least(F.lit(3.0), -spare / 10)).otherwise(0.0)
    parts = [
        coverage * 8.0,
        F.when((F.size(c["query_parts"]) > 0) & (coverage == 1.0), 3.0).otherwise(0.0),
        F.when((name != "") & F.contains(said, name), 5.0).otherwise(0.0),
        F.size(F.filter(c["dish_terms"], lambda t: F.contains(F.lower(c["item_name"]), t))) * 2.0,
        F.size(F.array_intersect(c["item_scenarios"], c["query_scenarios"])) * 3.0,
        time,
        F.coalesce(c["preference"] * 3.0, F.lit(0.0)),
        share(c["item_terms"], c["query_terms"]),
        c["quality"] * 0.01,
    ]
    return F.round(sum(parts[1:], parts[0]), 6)


def preference_match(scores: dict[str, Column], wanted: Column) -> Column:
    """The mean of the scores of the wanted preferences; null where none is wanted."""
    table = F.create_map(*(x for k, v in scores.items() for x in (F.lit(k), v.cast("double"))))
    return F.when(F.size(wanted) > 0, F.aggregate(wanted, F.lit(0.0), lambda s, p: s + table[p]) / F.size(wanted))


def rerank_score(semantic: Column, coverage: Column, scenarios: Column, quality: Column) -> Column:
    """The semantic score with small additions that part close candidates."""
    return semantic + coverage * 0.02 + scenarios * 0.005 + quality * 0.0001


def explained(wanted: Column, item_parts: Column, required: Column, scenarios: Column, max_minutes: Column, diets: Column, mild: Column) -> Column:
    """A struct of why (array of reasons), matched (wanted parts that the item has) and missing (required ones not wanted)."""
    matched = F.filter(wanted, lambda x: F.array_contains(item_parts, x))
    some = lambda a, text: F.when(F.size(a) > 0, F.concat(F.lit(text), F.array_join(a, ", ")))
    why = F.array(
        F.lit("multilingual semantic match"), some(matched, "matched ingredients: "), some(F.sort_array(scenarios), "matched scenario: "),
        F.when(max_minutes.isNotNull(), F.concat(F.lit("within "), max_minutes.cast("string"), F.lit(" minute limit"))),
        some(F.sort_array(diets), "satisfies dietary constraints: "), F.when(mild, "non-spicy constraint satisfied"),
    )
    return F.struct(F.array_compact(why).alias("why"), matched.alias("matched"), F.filter(required, lambda x: ~F.array_contains(wanted, x)).alias("missing"))


def hybrid_failure(known: Column, parts: Column, scenarios: Column, preferences: Column, minutes: Column, dishes: Column, in_rule: Column, in_vector: Column) -> Column:
    """The class of a query without its item in the top: known says whether the item is in the data, the rest what was parsed and which lane had it."""
    other = parts | scenarios | minutes | dishes
    return (
        F.when(~known, "MISSING_RECIPE_DATA")
        .when(~(other | preferences) | (preferences & ~other), "QUERY_PARSING_FAILURE")
        .when(~in_rule & ~in_vector, F.when((scenarios | preferences) & ~parts, "VECTOR_RETRIEVAL_FAILURE").otherwise("RULE_RANKING_FAILURE"))
        .otherwise("RERANKING_FAILURE")
    )


def benchmark_failure(known: Column, parts: Column, scenarios: Column, preferences: Column, minutes: Column, dishes: Column, in_candidates: Column, rank: Column, lane: Column, names_overlap: Column) -> Column:
    """The class of a failed query of a benchmark lane; rank is null where the item is not in the top."""
    other = parts | scenarios | minutes | dishes
    return (
        F.when(~known, "MISSING_RECIPE_COVERAGE")
        .when(~(other | preferences), "QUERY_PARSING_FAILURE")
        .when(preferences & ~other, "UNDER_SPECIFIED_USER_QUERY")
        .when(in_candidates & rank.isNull(), "RERANKING_FAILURE")
        .when(lane.endswith("hybrid") & ~in_candidates, "CANDIDATE_FUSION_FAILURE")
        .when(lane.startswith("real_embedding"), "EMBEDDING_SEMANTIC_FAILURE")
        .when(parts & ~names_overlap, "MISSING_ALIAS")
        .otherwise("RERANKING_FAILURE")
    )


#: Words of a dish's name that do not tell dishes apart.
_STYLES = "(?:低油|少油|家常|简单|快手|经典|健康)"


def diversity(answer: Column, names: Column, requested: Column) -> Column:
    """Share of different names among those the answer mentions (or else the first three); 1 if none were requested, 0.4 below two.

    A null answer mentions nothing; null or empty names don't count.
    """
    named = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), F.trim), lambda x: F.length(x) > 0)
    mentioned = F.filter(named, lambda x: F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lower(x)))
    chosen = F.when(F.size(mentioned) > 0, mentioned).otherwise(F.slice(named, 1, 3))
    plain = F.array_distinct(F.transform(chosen, lambda x: F.lower(F.trim(F.regexp_replace(x, _STYLES, "")))))
    share = F.when(F.size(chosen) < 2, F.lit(0.4)).otherwise(F.round(F.size(plain) / F.size(chosen), 4))
    return F.when(F.coalesce(requested, F.lit(False)), share).otherwise(F.lit(1.0))
