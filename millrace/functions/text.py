"""Text expressions: keys, tokens, n-grams, clauses. All are native columns but for NFKC forms, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lookup_key(c: Column) -> Column:
    """Trimmed, lower case, without spaces, underscores and hyphens."""
    return F.regexp_replace(F.lower(F.trim(c)), r"(?U)[\s_\-]+", "")


def compact(c: Column) -> Column:
    """Lower case letters, digits and underscores only, of any script."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def char_ngrams(c: Column, n: int = 3, whole_if_short: bool = True) -> Column:
    """The set of n-grams; a text of at most n characters is one gram, or none, as the two callers' rules differ."""
    grams = F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1)))
    if whole_if_short:
        return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) <= n, F.array(c)).otherwise(grams)
    return F.when(F.length(c) < n, F.array().cast("array<string>")).otherwise(grams)


def latin_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty sets are alike."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def unsafe_clause(c: Column, terms: str, negations: str, boundary: str = r"[。!?.！？;；\n]") -> Column:
    """Whether a clause holds one of the terms (a regular expression) and no negation."""
    return F.exists(F.split(c, boundary), lambda x: F.lower(x).rlike(terms) & ~F.lower(x).rlike(negations))


def title(c: Column, limit: int = 60) -> Column:
    t = collapsed(c)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def first_number(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("int")


def cjk_grams(c: Column, n: int) -> Column:
    """The n-grams of each run of CJK ideographs, in order."""
    runs = F.regexp_extract_all(c, F.lit("([\u4e00-\u9fff]+)"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: r.substr(i, F.lit(n))))))


def tokens(c: Column) -> Column:
    """Latin words, then the 2- and 3-grams of CJK runs (all of one length before the next); a bag, with repeats."""
    return F.concat(latin_tokens(c), cjk_grams(c, 2), cjk_grams(c, 3))


def simple_terms(c: Column) -> Column:
    """The set of Latin words (without underscores) and CJK 2-grams."""
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), cjk_grams(c, 2)))


def plain_name(c: Column) -> Column:
    """Lower case, Latin letters, digits and CJK ideographs only."""
    return F.regexp_replace(F.lower(c), "[^0-9a-z\u4e00-\u9fff]", "")


def aliased_key(c: Column, aliases: dict[str, str]) -> Column:
    """lookup_key, by its alias where it has one; aliases are few and stand in the plan."""
    key = lookup_key(c)
    if not aliases:
        return key
    return F.coalesce(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))[key], key)


@F.pandas_udf(T.StringType())
def _nfkc(c: pd.Series) -> pd.Series:
    return c.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def evidence(c: Column) -> Column:
    """NFKC form in lower case, white space collapsed. Only texts beyond ASCII go to Python; null stays null."""
    whole = F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)
    return F.trim(F.regexp_replace(F.lower(whole), r"\s+", " "))


def requested_count(requested: Column) -> Column:
    """How many different things an array of (name, id) asks for: by id, or by the name's key where the id is null."""
    return F.size(F.array_distinct(F.transform(requested, lambda r: F.coalesce(r["id"].cast("string"), F.concat(F.lit("unknown:"), F.coalesce(lookup_key(r["name"]), F.lit("")))))))
