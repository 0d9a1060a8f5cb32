"""Constraints said in free text: names of a vocabulary, what is ruled out, equipment, numbers, and their merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that rule something out before or after its name.
NEGATIVE_CLAUSES = (
    r"(?:不要|不吃|不放|避免|排除|去掉|忌口)\s*([^，,。！？.!?;；\n]+)",
    r"(?:do not eat|don't eat|avoid|without|exclude|no)\s+([^,.!?;\n]+)",
    r"([^，,。！？.!?;；\n]+?)(?:过敏|allergy|allergic)",
)
SERVINGS = r"(\d{1,2})\s*(?:人份|人|servings?)"
MINUTES = r"(\d{1,3})\s*分钟"


_automata: dict[tuple[str, ...], object] = {}


def _automaton(aliases: tuple[str, ...]):
    """One automaton a worker and vocabulary; aliases by their order."""
    if aliases not in _automata:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for place, alias in enumerate(aliases):
            if alias not in automaton:
                automaton.add_word(alias, (place, alias))
        automaton.make_automaton()
        _automata[aliases] = automaton
    return _automata[aliases]


def mentioned(text: str | None, aliases: tuple[str, ...]) -> list[str]:
    """Aliases (lower case, longest first) in a text as it spells them; see mentions()."""
    text = text or ""
    folded, out = text.lower(), []
    if not aliases or not folded:
        return out
    latin = lambda c: c.isascii() and c.isalnum()
    hits = []
    for last, (place, alias) in _automaton(aliases).iter(folded):
        start, stop = last - len(alias) + 1, last + 1
        if not alias.isascii() or not ((start and latin(folded[start - 1])) or (stop < len(folded) and latin(folded[stop]))):
            hits.append((place, start, stop))
    taken = bytearray(len(folded))  # characters that a longer or earlier one has
    before = (-1, 0)  # the alias before, and where its last place ends: places of one alias never overlap
    for place, start, stop in sorted(hits):
        if place == before[0] and start < before[1]:
            continue
        before = (place, stop)
        if not any(taken[start:stop]):
            taken[start:stop] = b"\x01" * (stop - start)
            out.append((text if len(text) == len(folded) else folded)[start:stop])
    return out


def mentions(c: Column, aliases: list[str]) -> Column:
    """Aliases in the text as it spells them, longest alias first, none over another; Latin ones stand between other signs.

    One pass over a text finds all of a vocabulary, of any size that a worker holds; empty aliases are left out.
    """
    ordered = tuple(sorted((a.lower() for a in aliases if a), key=len, reverse=True))

    @F.pandas_udf("array<string>")
    def found(texts):
        import pandas as pd

        return pd.Series([mentioned(t, ordered) for t in texts])

    return found(c)


def negative_clauses(c: Column) -> Column:
    """The clauses that follow or precede words that rule out."""
    return F.concat(*(F.regexp_extract_all(F.lower(c), F.lit(p), F.lit(1)) for p in NEGATIVE_CLAUSES))


def excluded_mentions(texts: DataFrame, item: str, text: str, aliases: list[str]) -> DataFrame:
    """(item, value): names in clauses that rule them out."""
    clauses = texts.select(item, F.explode(negative_clauses(F.col(text))).alias("_clause"))
    return clauses.select(item, F.explode(mentions(F.col("_clause"), aliases)).alias("value")).distinct()


def polarity(c: Column, aliases: list[str], before: tuple[str, ...], after: tuple[str, ...], reach: tuple[int, int] = (8, 12)) -> Column:
    """'available' or 'unavailable' by the words around the first alias that the text has; null where it has none."""
    text, out = F.lower(c), F.lit(None).cast("string")
    for alias in reversed(aliases):
        at = F.locate(alias, text)
        prefix = F.substring(text, F.greatest(F.lit(1), at - reach[0]), F.least(at - 1, F.lit(reach[0])))
        suffix = F.substring(text, at + len(alias), F.lit(reach[1]))
        ruled_out = F.lit(False)
        for word in before:
            ruled_out = ruled_out | prefix.endswith(word)
        for word in after:
            ruled_out = ruled_out | suffix.startswith(word)
        out = F.when(at > 0, F.when(ruled_out, "unavailable").otherwise("available")).otherwise(out)
    return out


def number(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.lower(c), pattern, 1), F.lit("")).cast("int")


def asks(c: Column, markers: str, denial: str) -> Column:
    """Whether the text, what it denies taken out, has one of the markers (both are regular expressions)."""
    return F.regexp_replace(F.lower(c), denial, "").rlike(markers)


def ordered_values(rows: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """For each key the distinct entries of array columns in the order of rows: the first place of each counts."""
    out = None
    for v in values:
        flat = rows.select(key, at, F.posexplode(v).alias("_i", "_v"))
        first = flat.groupBy(key, "_v").agg(F.min(F.struct(at, "_i")).alias("_at"))
        one = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(v))
        out = one if out is None else out.join(one, key, "full_outer")
    return rows.select(key).distinct().join(out, key, "left").select(key, *(F.coalesce(F.col(v), F.array().cast("array<string>")).alias(v) for v in values))


def last_values(rows: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """For each key the last value of each column that isn't null."""
    return rows.groupBy(key).agg(*(F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(at))).alias(v) for v in values))


def merged(supplied: Column, enforced: Column, minus: Column | None = None) -> Column:
    """Supplied values, then enforced ones, each once, without those of minus (in any case of letters)."""
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce(supplied, none), F.coalesce(enforced, none)))
    if minus is None:
        return both
    gone = F.transform(F.coalesce(minus, none), F.lower)
    return F.filter(both, lambda x: ~F.array_contains(gone, F.lower(x)))


def enforced_first(supplied: Column, enforced: Column) -> Column:
    return F.coalesce(enforced, supplied)


def resolved(names: DataFrame, canonical: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, id, ordinal): ids of names (query_id, ordinal, key), by canonical (key, id) before aliases (key, id), each once.

    A name that neither knows is `unknown:` and its key.
    """
    by_name, by_alias = canonical.select("key", F.col("id").alias("_c")), aliases.select("key", F.col("id").alias("_a"))
    found = names.join(by_name, "key", "left").join(by_alias, "key", "left")
    found = found.withColumn("id", F.coalesce("_c", "_a", F.concat(F.lit("unknown:"), "key")))
    first = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("ordinal"))
    return found.withColumn("_n", first).where("_n = 1").select("query_id", "id", "ordinal")
