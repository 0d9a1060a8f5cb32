"""Review of record pairs that may be one dish under two names: from records to decisions, and the first near pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import parts, similarity
from .blocks import rounded
from .names import name_pairs, ratio

#: What a decision asks for at least: alike in ingredients, or in name.
INGREDIENTS, NAME = 0.65, 0.78
#: What rejection across names asks for: alike in both, with equal methods.
REJECTED_INGREDIENTS, REJECTED_NAME = 0.8, 0.55


def review_kinds(records: DataFrame) -> DataFrame:
    """records (ordinal, name, core, methods, steps) by kind: those that differ in ordinal alone are one, with the least ordinal.

    name_key is the name's plain form; null arrays are empty, a null name or text is an empty one.
    """
    return _keyed(records).groupBy("name_key", "core", "methods", "steps").agg(F.min("ordinal").alias("ordinal"), F.count(F.lit(1)).alias("records"))


def pair_reviews(records: DataFrame, measure: str = "sequence") -> DataFrame:
    """(left_id, right_id, name, ingredients, methods, steps, same_name, decision): the pairs of kinds that a decision falls on.

    records: ordinal, name, core (ids), methods, steps (text). Left is the kind with the lesser ordinal; an id is the
    least ordinal of a kind (see review_kinds), so copies are not multiplied into pairs: `members` tells whose copies
    they are, and all of them but the first are rejected. Similarities are rounded to four places after the decision.

    A decision needs likeness of names or of ingredients, which no one index serves. It is the union of two lossless
    joins: sets of ingredients by their rarest members, names by bounds of their parts (names.name_pairs). Kinds
    of one name are all pairs of one another and meet by the name, see same_names.
    """
    kinds = review_kinds(records).checkpoint()
    sets = kinds.groupBy("core").agg(F.min("ordinal").alias("id"))
    alike = similarity.set_pairs(sets.withColumnRenamed("core", "elements"), [], INGREDIENTS).select("left_id", "right_id")
    alike = alike.unionByName(sets.select(F.col("id").alias("left_id"), F.col("id").alias("right_id")))
    of_set = kinds.join(sets.withColumnRenamed("id", "set_id").hint("merge"), "core").select("ordinal", "set_id")
    by_core = alike.join(_side(of_set, "set_id", "left_id", "x"), "left_id").join(_side(of_set, "set_id", "right_id", "y"), "right_id").select("x", "y")
    named = name_pairs(kinds.select(F.col("name_key").alias("name")), NAME, measure).select(F.col("a").alias("left_id"), F.col("b").alias("right_id"))
    by_name = named.join(_side(kinds, "name_key", "left_id", "x"), "left_id").join(_side(kinds, "name_key", "right_id", "y"), "right_id").select("x", "y")
    met = by_core.unionByName(by_name).where("x <> y").select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).distinct()
    # ingredients and steps are as large as the records, whatever a plan takes them for: never sent to all tasks; steps meet decided pairs alone
    left, right = (kinds.select(F.col("ordinal").alias(f"{s}_id"), F.struct("name_key", "core", "methods").alias(s[0])).hint("merge") for s in ("left", "right"))
    pairs = met.join(left, "left_id").join(right, "right_id").where("l.name_key <> r.name_key")
    pairs = pairs.select(
        "left_id", "right_id", (F.col("l.name_key") == F.col("r.name_key")).alias("same_name"), ratio(measure, F.col("l.name_key"), F.col("r.name_key")).alias("name"),
        text.jaccard(F.col("l.core"), F.col("r.core")).alias("ingredients"), text.jaccard(F.col("l.methods"), F.col("r.methods")).alias("methods"),
    )
    judged = similarity.reviewed(pairs)
    for side in ("left", "right"):
        judged = judged.join(kinds.select(F.col("ordinal").alias(f"{side}_id"), F.col("steps").alias(f"_{side[0]}")).hint("merge"), f"{side}_id")
    grams = [text.char_ngrams(F.col(c), whole_if_short=False) for c in ("_l", "_r")]
    rounded = [F.round(c, 4).alias(c) for c in ("name", "ingredients", "methods")]
    judged = judged.select("left_id", "right_id", "same_name", *rounded, F.round(text.jaccard(*grams), 4).alias("steps"), "decision")
    return judged.unionByName(same_names(kinds))


#: Kinds of one name that meet as one part, and grams that are compared at once.
PART, GRAMS = 256, 8_192


def same_names(kinds: DataFrame) -> DataFrame:
    """The reviews of all pairs of kinds of one name: rejected, with their similarities.

    A name's kinds are dealt into parts, every two of which meet in one task, where matrix products give what the
    members have in common; so a text goes to as many tasks as its name has parts, not to as many as it has partners.
    """
    often = kinds.groupBy(F.col("name_key").alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    dealt = kinds.join(often.hint("merge"), F.col("name_key") == F.col("_key")).withColumn("_parts", F.ceil(F.col("_n") / PART).cast("int"))
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("ordinal"), F.col("_parts")).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.select("name_key", F.least("_part", "_with").alias("_low"), F.greatest("_part", "_with").alias("_high"), "_part", "ordinal", "core", "methods", "steps")
    ordinal = kinds.schema["ordinal"].dataType.simpleString()
    schema = f"left_id {ordinal}, right_id {ordinal}, ingredients double, methods double, steps double"
    met = dealt.groupBy("name_key", "_low", "_high").applyInArrow(lambda rows: _of_one_name(rows), schema)
    return met.select("left_id", "right_id", F.lit(True).alias("same_name"), F.lit(1.0).alias("name"), "ingredients", "methods", "steps", F.lit("REJECT_RIGHT").alias("decision"))


def _of_one_name(rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks().sort_by("ordinal")
    part = rows.column("_part").to_numpy()
    i, j = np.triu_indices(len(part), 1)
    if rows.column("_low")[0].as_py() != rows.column("_high")[0].as_py():
        apart = part[i] != part[j]
        i, j = i[apart], j[apart]
    number: dict[str | None, int] = {}
    sets = [[np.array([number.setdefault(e, len(number)) for e in s], np.int64) for s in rows.column(c).to_pylist()] for c in ("core", "methods")]
    sets.append([_grams(t) for t in rows.column("steps").to_pylist()])
    ids = rows.column("ordinal")
    return pa.table([ids.take(pa.array(i)), ids.take(pa.array(j)), *(rounded(_jaccard(s)[i, j], 4) for s in sets)], names=["left_id", "right_id", "ingredients", "methods", "steps"])


def _grams(steps: str) -> np.ndarray:
    """The set of a text's 3-grams, each as one number of three code points."""
    c = np.frombuffer(steps.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """Of every two sets (arrays of different numbers), from their common members; two empty sets are alike."""
    n = np.array([len(s) for s in sets])
    known, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner, both = np.repeat(np.arange(len(n)), n), np.zeros((len(n), len(n)))
    for lo in range(0, len(known), GRAMS):
        here = (at >= lo) & (at < lo + GRAMS)
        held = np.zeros((len(n), min(GRAMS, len(known) - lo)), np.float32)
        held[owner[here], at[here] - lo] = 1
        both += held @ held.T
    either = n[:, None] + n[None] - both
    return np.where(either == 0, 1.0, both / np.maximum(either, 1))


def _side(rows: DataFrame, key: str, renamed: str, ordinal: str) -> DataFrame:
    return rows.select(F.col(key).alias(renamed), F.col("ordinal").alias(ordinal))


def members(records: DataFrame) -> DataFrame:
    """(ordinal, kind): each record's kind, by the least ordinal of it."""
    keys = ["name_key", "core", "methods", "steps"]
    return _keyed(records).join(review_kinds(records).select(*keys, F.col("ordinal").alias("kind")).hint("merge"), keys).select("ordinal", "kind")


def _keyed(records: DataFrame) -> DataFrame:
    sets = [F.array_sort(F.array_distinct(F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")))).alias(c) for c in ("core", "methods")]
    return records.select("ordinal", text.plain_name(F.coalesce("name", F.lit(""))).alias("name_key"), *sets, text.plain_name(F.coalesce("steps", F.lit(""))).alias("steps"))


def rejected(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """(id): records that repeat an earlier one: copies of a kind but the first, and all records of a kind that is rejected."""
    bad = similarity.rejected_ids(reviews).withColumnRenamed("id", "kind")
    at = members(records)
    return at.join(bad.withColumn("_bad", F.lit(True)), "kind", "left").where(F.col("_bad") | (F.col("ordinal") != F.col("kind"))).select(F.col("ordinal").alias("id"))


def rejected_records(records: DataFrame, measure: str = "sequence") -> DataFrame:
    """(id): what rejected() makes of pair_reviews(), without a list of pairs.

    A record is rejected if it is not the first of its name, so kinds of one name need no pairs. Across names it takes
    ingredients alike by 0.8, equal methods and names alike by 0.55, with an earlier kind; texts are no part of this.
    They tell kinds apart by a digest. Records of a name's first ordinal alone are asked for earlier ones.
    """
    keyed = _keyed(records)
    rows = keyed.select("ordinal", "name_key", F.sha2(F.to_json(F.struct("core", "methods", "steps")), 256).alias("digest")).checkpoint()
    kinds = rows.groupBy("name_key", "digest").agg(F.min("ordinal").alias("kind"))
    firsts = rows.groupBy("name_key").agg(F.min("ordinal").alias("first")).checkpoint()
    later = kinds.join(firsts.hint("merge"), "name_key").where("kind > first").select(F.col("kind").alias("id"))
    # forms: kinds but for their steps
    forms = keyed.groupBy("name_key", "core", "methods").agg(F.min("ordinal").alias("id")).where("id is not null").withColumn("group", F.xxhash64("name_key")).checkpoint()
    met = parts.alike_candidates(forms.select("id", F.transform("core", lambda x: F.xxhash64(x)).alias("elements"), "group"), REJECTED_INGREDIENTS)
    bare = forms.where(F.size("core") == 0).select("id", "group", "methods")
    sides = [bare.select("methods", F.col("id").alias(f"{s}_id"), F.col("group").alias(f"_{s}")) for s in ("left", "right")]
    empty = sides[0].join(sides[1].hint("merge"), "methods").where("left_id < right_id and _left <> _right").select("left_id", "right_id")
    first = firsts.select(F.col("first").alias("right_id")).distinct()
    left, right = (forms.select(F.col("id").alias(f"{s}_id"), F.struct("name_key", "methods").alias(s)).hint("merge") for s in ("left", "right"))
    met = met.unionByName(empty).join(first.hint("merge"), "right_id", "left_semi").join(left, "left_id").join(right, "right_id")
    n = F.length("left.name_key"), F.length("right.name_key")
    # neither measure exceeds what the lengths allow
    fits = 2 * F.least(*n) >= REJECTED_NAME * (n[0] + n[1]) - 1e-9 if measure == "sequence" else F.least(*n) >= REJECTED_NAME * F.greatest(*n) - 1e-9
    met = met.where(fits & (text.jaccard(F.col("left.methods"), F.col("right.methods")) >= 0.99))
    named = met.where(ratio(measure, F.col("left.name_key"), F.col("right.name_key")) >= REJECTED_NAME).select("left_id", "right_id").checkpoint()
    left, right = (forms.select(F.col("id").alias(f"{s}_id"), F.col("core").alias(s)).hint("merge") for s in ("left", "right"))
    alike = named.join(left, "left_id").join(right, "right_id").where(text.jaccard(F.col("left"), F.col("right")) >= REJECTED_INGREDIENTS)
    bad = later.unionByName(alike.select(F.col("right_id").alias("id"))).distinct().select(F.col("id").alias("kind"), F.lit(True).alias("_bad"))
    at = rows.join(kinds.hint("merge"), ["name_key", "digest"]).select("ordinal", "kind")
    return at.join(bad.hint("merge"), "kind", "left").where(F.col("_bad") | (F.col("ordinal") != F.col("kind"))).select(F.col("ordinal").alias("id"))


#: Records of the first block of first_near_pairs, how each next one grows, and how many are tried so before all pairs are joined.
FIRST_LEFTS, GROWTH, MOST_LEFTS = 64, 2, 2_000


def first_near_pairs(records: DataFrame, ingredients: float = INGREDIENTS, name: float = 0.6, first: int = 20, measure: str = "sequence") -> DataFrame:
    """(left_id, right_id): the first pairs, in order, of one category that are alike in ingredients and in name.

    records: ordinal, category, name, core. Names are compared as they are; a null category is none; null arrays are
    empty sets, which are alike; a null name is like no other. `first` is a report's length.

    As pairs go by their left record, blocks of the least ordinals meet all later records, without a shuffle, until
    `first` pairs are found: no later block has an earlier pair. Records past MOST_LEFTS are joined by their sets.
    """
    core = F.array_distinct(F.coalesce(F.col("core").cast("array<string>"), F.array().cast("array<string>")))
    known = records.where("category is not null and name is not null and ordinal is not null").select("ordinal", "category", "name", core.alias("core")).checkpoint()
    found, count, tried, size, after = known.select(F.col("ordinal").alias("left_id"), F.col("ordinal").alias("right_id")).limit(0), 0, 0, FIRST_LEFTS, None
    while True:
        rest = known if after is None else known.where(F.col("ordinal") > F.lit(after))
        if tried >= MOST_LEFTS:
            pairs = similarity.set_pairs(rest.select("category", "ordinal", F.col("core").alias("elements")), ["category"], ingredients, item="ordinal")
            names = [rest.select(F.col("ordinal").alias(f"{s}_id"), F.col("name").alias(s)) for s in ("left", "right")]
            met = pairs.select("left_id", "right_id").join(names[0], "left_id").join(names[1], "right_id")
            met = met.where(ratio(measure, F.col("left"), F.col("right")) >= name).select("left_id", "right_id")
            break
        last = rest.select("ordinal").distinct().orderBy("ordinal").limit(size).agg(F.max("ordinal")).first()[0]
        if last is None:
            met = found.limit(0)
            break
        met = _near_lefts(rest.where(F.col("ordinal") <= F.lit(last)), rest, ingredients, name, measure).orderBy("left_id", "right_id").limit(first - count).checkpoint()
        found, count = found.unionByName(met), count + met.count()
        if count >= first:
            met = found.limit(0)
            break
        tried, size, after = tried + size, size * GROWTH, last
    return found.unionByName(met).orderBy("left_id", "right_id").limit(first)


def _near_lefts(lefts: DataFrame, rights: DataFrame, ingredients: float, name: float, measure: str) -> DataFrame:
    """Pairs of a block of records, sent to all tasks, and those after them; what is cheap to tell is asked first."""
    left, right = (df.select("category", *(F.col(c).alias(f"{s}_{c}") for c in ("ordinal", "name", "core"))) for df, s in ((lefts, "left"), (rights, "right")))
    sizes = F.size("left_core"), F.size("right_core")
    fits = (F.col("left_ordinal") < F.col("right_ordinal")) & (F.least(*sizes) >= ingredients * F.greatest(*sizes) - 1e-9)
    a, b = F.col("left_name"), F.col("right_name")
    n = F.length(a), F.length(b)
    # neither measure exceeds what the lengths allow; an edit distance beyond the most is not computed to its end
    if measure == "edit":
        most = F.floor(F.greatest(*n) * (1 - name) + 1e-9).cast("int")
        fits &= (F.abs(n[0] - n[1]) <= most) & (F.levenshtein(a, b) <= most)
    else:
        fits &= 2 * F.least(*n) >= name * (n[0] + n[1]) - 1e-9
    met = right.join(F.broadcast(left), "category").where(fits & (text.jaccard(F.col("left_core"), F.col("right_core")) >= ingredients))
    return met.where(ratio(measure, a, b) >= name).select(F.col("left_ordinal").alias("left_id"), F.col("right_ordinal").alias("right_id"))
