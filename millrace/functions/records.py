"""Rules over nested records: coded issues, component scores and gates, audits. All are native columns.

A record has record_id, name, summary, aliases, ingredients (id, name, role), steps (ordinal, instruction, method,
phase, duration, temperature, ingredient_refs, equipment_refs, safety_note), equipment (required, optional),
total_minutes, nutrition (calories, protein, fat, carbohydrate, protein_level, fat_level), scenario, license,
reliability. Null arrays are empty; a null number gives no issue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = """record_id long, name string, summary string, aliases array<string>,
ingredients array<struct<id:string,name:string,role:string>>,
steps array<struct<ordinal:int,instruction:string,method:string,phase:string,duration:double,temperature:double,
  ingredient_refs:array<string>,equipment_refs:array<string>,safety_note:string>>,
equipment struct<required:array<string>,optional:array<string>>, total_minutes double,
nutrition struct<calories:double,protein:double,fat:double,carbohydrate:double,protein_level:string,fat_level:string>,
scenario array<string>, license string, reliability double"""

# Phrases and names that the rules look for, and the weights and limits of scores.
UNSAFE_PHRASES = ("生吃鸡肉", "生食鸡肉", "raw chicken", "drink bleach", "食用漂白剂")
MEDICAL_CLAIMS = ("治疗癌症", "治愈癌症", "包治百病", "cure cancer", "cures disease")
BANNED_CLAIMS = (
    "燃脂", "排毒", "易消化", "适合老年人", "适合儿童", "保证健康", "零失败",
    "治疗", "治愈", "降血糖", "降血压", "fat-burning", "detox", "guaranteed healthy",
)
SENSITIVE_NAMES = (
    "鸡肉", "鸡腿", "鸡翅", "整鸡", "鸭肉", "鸭腿", "鸡胗", "鸡爪", "猪肉", "五花肉",
    "猪排骨", "猪蹄", "猪肝", "猪肚", "肉馅", "牛肉", "羊肉", "羊排", "鱼", "鲈鱼",
    "草鱼", "鲫鱼", "鳕鱼", "带鱼", "金枪鱼", "三文鱼", "虾", "鱿鱼", "蛤蜊", "扇贝",
    "螃蟹", "鸡蛋",
)
EATEN_RAW = ("金枪鱼",)
AUDIENCE_CLAIMS = ("控脂", "减肥", "健身", "老人", "小孩", "易消化", "零失败")
POULTRY, POULTRY_CUES = ("鸡肉", "鸡腿", "鸡翅"), ("74", "熟透", "无血水", "完全变白")
FISH_CUES = ("63", "熟透", "鱼肉变白", "轻易剥离")
WEIGHTS = {"source_reliability": 0.30, "schema_completeness": 0.15, "ingredient_consistency": 0.20, "step_consistency": 0.20, "safety": 0.15}
COMPONENTS = {
    "ingredient_consistency": ("INGREDIENT_", "REQUIRED_", "UNKNOWN_STEP_INGREDIENT"),
    "step_consistency": ("STEP_",),
    "safety": ("UNSAFE_", "UNSUPPORTED_MEDICAL_", "IMPLAUSIBLE_", "NUTRITION_"),
}


def strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def names_one(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether lower-cased text holds one of the phrases."""
    return F.coalesce(F.exists(F.array(*(F.lit(p.lower()) for p in phrases)), lambda p: F.contains(F.lower(text), p)), F.lit(False))


def issue(code: str, path: Column, severity: str = "ERROR") -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), path.alias("path"))


_NONE = "array<struct<code:string,severity:string,path:string>>"


def once(bad: Column, code: str, path: str, severity: str = "ERROR") -> Column:
    """One issue where bad is true; where it is false or null, none."""
    return F.when(bad, F.array(issue(code, F.lit(path), severity))).otherwise(F.array().cast(_NONE))


def each(items: Column, bad: Callable[[Column], Column], code: str, path: str) -> Column:
    """An issue for every bad item; path has its place, from 0, for the percent sign."""
    before, after = path.split("%")
    marked = F.transform(items, lambda x, i: F.when(bad(x), issue(code, F.concat(F.lit(before), i.cast("string"), F.lit(after)))))
    return F.coalesce(F.filter(marked, lambda m: m.isNotNull()), F.array().cast(_NONE))


def ingredient_ids() -> Column:
    return strings(F.col("ingredients.id"))


def step_refs(field: str) -> Column:
    return strings(F.flatten(F.filter(F.col(f"steps.{field}"), lambda r: r.isNotNull())))


def declared_equipment() -> Column:
    return F.concat(strings(F.col("equipment.required")), strings(F.col("equipment.optional")))


def active_minutes() -> Column:
    return F.aggregate(F.coalesce(F.col("steps.duration"), F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def searchable() -> Column:
    """Name, summary, instructions and safety notes, by spaces."""
    return F.concat_ws(" ", "name", "summary", F.col("steps.instruction"), F.col("steps.safety_note"))


def local_issues() -> Column:
    """The issues that a record shows by itself, as array<struct<code, severity, path>>."""
    ids, refs, equipment = ingredient_ids(), step_refs("ingredient_refs"), declared_equipment()
    kcal, protein, fat, carbohydrate = (F.col(f"nutrition.{k}") for k in ("calories", "protein", "fat", "carbohydrate"))
    unknown = F.transform("steps", lambda s, i: F.transform(
        F.filter(strings(s["ingredient_refs"]), lambda r: ~F.array_contains(ids, r)),
        lambda r: issue("UNKNOWN_STEP_INGREDIENT", F.concat(F.lit("steps["), i.cast("string"), F.lit("].ingredient_refs"))),
    ))
    orders = F.coalesce(F.col("steps.ordinal"), F.array().cast("array<int>"))
    expected = F.when(F.size(orders) > 0, F.sequence(F.lit(1), F.size(orders))).otherwise(F.array().cast("array<int>"))
    estimated = protein * 4 + fat * 9 + carbohydrate * 4
    return F.concat(
        each(F.col("ingredients"), lambda x: (x["role"] == "REQUIRED") & ~F.array_contains(refs, x["id"]), "REQUIRED_INGREDIENT_UNUSED", "ingredients[%]"),
        F.coalesce(F.flatten(unknown), F.array().cast(_NONE)),
        once(orders != expected, "STEP_ORDER_INVALID", "steps"),
        each(F.col("steps"), lambda s: F.size(F.array_except(strings(s["equipment_refs"]), equipment)) > 0, "STEP_EQUIPMENT_UNDECLARED", "steps[%].equipment_refs"),
        once(active_minutes() > F.col("total_minutes") * 1.5, "STEP_TIME_MISMATCH", "time.total_minutes", "WARNING"),
        once(names_one(searchable(), UNSAFE_PHRASES), "UNSAFE_COOKING_INSTRUCTION", "steps"),
        once(names_one(searchable(), MEDICAL_CLAIMS), "UNSUPPORTED_MEDICAL_CLAIM", "identity.summary"),
        each(F.col("steps"), lambda s: s["temperature"] > 350, "IMPLAUSIBLE_TEMPERATURE", "steps[%].temperature_celsius"),
        once(kcal > 2000, "IMPLAUSIBLE_CALORIES", "nutrition.calories_kcal"),
        once(F.greatest(protein, fat, carbohydrate) > 250, "IMPLAUSIBLE_MACRONUTRIENT", "nutrition"),
        once(F.abs(estimated - kcal) > 0.6 * F.greatest(F.abs(estimated), F.abs(kcal)), "NUTRITION_CALORIE_MISMATCH", "nutrition", "WARNING"),
    )


def issues(records: DataFrame, catalog: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """(record_id, code, severity, path): a row for each issue of each record.

    catalog: (id, name) of the known ingredients; duplicates: (record_id) of records found to repeat an earlier one.
    """
    own = records.select("record_id", F.inline(local_issues()))
    listed = records.select("record_id", F.posexplode("ingredients").alias("at", "item")).select("record_id", "at", F.col("item.id").alias("id"), F.col("item.name").alias("name"))
    known = catalog.select("id", F.col("name").alias("known"))
    wrong = listed.join(known, "id", "left").where(F.col("known").isNull() | (F.col("known") != F.coalesce("name", F.lit(""))))
    path = F.concat(F.lit("ingredients["), F.col("at").cast("string"), F.lit("]"))
    out = own.unionByName(wrong.select("record_id", F.lit("INGREDIENT_CATALOG_MISMATCH").alias("code"), F.lit("ERROR").alias("severity"), path.alias("path")))
    if duplicates is not None:
        out = out.unionByName(duplicates.select("record_id", F.lit("DUPLICATE_RECIPE").alias("code"), F.lit("ERROR").alias("severity"), F.lit("identity.name").alias("path")))
    return out


def completeness() -> Column:
    """0.8 and 0.2 of the share of seven optional things that are given."""
    numbers = [F.col(f"nutrition.{k}").isNotNull() for k in ("calories", "protein", "fat", "carbohydrate")]
    given = [F.size(strings(F.col("aliases"))) > 0, *numbers, F.size(strings(F.col("scenario"))) > 0, F.coalesce(F.col("license"), F.lit("")) != ""]
    return 0.8 + 0.2 * (sum((g.cast("int") for g in given), F.lit(0)) / len(given))


def quality(records: DataFrame, found: DataFrame) -> DataFrame:
    """record_id, the five components, score and status (REJECTED, REVIEW, PUBLISHED) of each record, from its issues."""
    counts = []
    for name, prefixes in COMPONENTS.items():
        mine = F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.col("code").startswith(p))
        for severity in ("ERROR", "WARNING"):
            counts.append(F.sum((mine & (F.col("severity") == severity)).cast("int")).alias(f"{name}_{severity}"))
    per_record = found.groupBy("record_id").agg(F.sum((F.col("severity") == "ERROR").cast("int")).alias("errors"), *counts)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    scores = {"source_reliability": F.col("reliability"), "schema_completeness": completeness()}
    scores |= {k: F.greatest(F.lit(0.0), 1.0 - n(f"{k}_ERROR") * 0.5 - n(f"{k}_WARNING") * 0.15) for k in COMPONENTS}
    out = records.join(per_record, "record_id", "left").select("record_id", n("errors").alias("errors"), *(c.alias(k) for k, c in scores.items()))
    out = out.withColumn("score", F.round(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)), 4))
    status = F.when((F.col("errors") > 0) | (F.col("score") < 0.70), "REJECTED").when(F.col("score") < 0.85, "REVIEW").otherwise("PUBLISHED")
    return out.select("record_id", *(F.round(k, 4).alias(k) for k in WEIGHTS), "score", status.alias("status"))


def audit(records: DataFrame) -> DataFrame:
    """record_id, decision, score, issue_codes, safety_sensitive of each record: the second gate, apart from quality()."""
    n = F.col("nutrition")
    level = lambda k: F.coalesce(n[k], F.lit("UNKNOWN")) != "UNKNOWN"
    numbered = F.coalesce(*(n[k].cast("string") for k in ("calories", "protein", "fat", "carbohydrate"))).isNotNull()
    names = strings(F.col("ingredients.name"))
    sensitive = F.arrays_overlap(names, F.array(*map(F.lit, SENSITIVE_NAMES)))
    raw = F.arrays_overlap(names, F.array(*(F.lit(x) for x in SENSITIVE_NAMES if x not in EATEN_RAW)))
    cue = F.exists(strings(F.col("steps.safety_note")), lambda note: F.coalesce(note, F.lit("")) != "")
    cooks = F.array_contains(strings(F.col("steps.phase")), "COOK")
    rules = [
        ("UNSUPPORTED_CLAIM", names_one(searchable(), BANNED_CLAIMS)),
        ("UNVERIFIED_SYNTHETIC_NUTRITION", numbered | level("protein_level") | level("fat_level")),
        ("INGREDIENT_STEP_INCONSISTENCY", F.size(F.array_except(ingredient_ids(), step_refs("ingredient_refs"))) > 0),
        ("EQUIPMENT_INCONSISTENCY", F.size(F.array_except(step_refs("equipment_refs"), declared_equipment())) > 0),
        ("TIME_UNREALISTIC", (active_minutes() > F.col("total_minutes") * 1.5) | (F.col("total_minutes") < 5)),
        ("FOOD_SAFETY_CUE_MISSING", sensitive & ~F.coalesce(cue, F.lit(False))),
        ("COOKING_STAGE_MISSING", raw & ~cooks),
    ]
    codes = F.array_compact(F.array(*(F.when(bad, code) for code, bad in rules)))
    out = records.select("record_id", codes.alias("issue_codes"), F.coalesce(sensitive, F.lit(False)).alias("safety_sensitive"))
    rejecting = F.size(F.filter("issue_codes", lambda c: c != "TIME_UNREALISTIC")) > 0
    decision = F.when(rejecting, "REJECTED").when(F.size("issue_codes") > 0, "FLAGGED").otherwise("AUDIT_PASSED")
    return out.select("record_id", decision.alias("decision"), F.greatest(F.lit(0.0), F.round(1.0 - 0.18 * F.size("issue_codes"), 3)).alias("score"), "issue_codes", "safety_sensitive")


def concerns(records: DataFrame) -> DataFrame:
    """(record_id, concern): what makes a record doubtful for a household."""
    names, methods = strings(F.col("ingredients.name")), strings(F.col("steps.method"))
    said = F.concat_ws("", F.col("steps.instruction"))
    holds = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    numbered = F.coalesce(*(F.col("nutrition")[k].cast("string") for k in ("calories", "protein", "fat", "carbohydrate"))).isNotNull()
    rules = [
        ("TOO_FEW_INGREDIENTS", F.size(names) < 2),
        ("TOO_MANY_HOUSEHOLD_INGREDIENTS", F.size(names) > 15),
        ("TOO_FEW_EXECUTABLE_STEPS", F.size(methods) < 2),
        ("HOUSEHOLD_TIME_OVER_180_MINUTES", F.col("total_minutes") > 180),
        ("NO_COOKING_METHOD", F.forall(methods, lambda m: m == "PREPARE")),
        ("UNVERIFIED_SYNTHETIC_NUTRITION", numbered),
        ("HEALTH_OR_AUDIENCE_CLAIM_REQUIRES_REVIEW", holds(F.coalesce("summary", F.lit("")), AUDIENCE_CLAIMS)),
        ("POULTRY_DONENESS_UNCLEAR", F.arrays_overlap(names, F.array(*map(F.lit, POULTRY))) & ~holds(said, POULTRY_CUES)),
        ("FISH_DONENESS_UNCLEAR", F.exists(names, lambda x: F.contains(x, F.lit("鱼"))) & ~holds(said, FISH_CUES)),
    ]
    return records.select("record_id", F.explode(F.array_compact(F.array(*(F.when(bad, code) for code, bad in rules)))).alias("concern"))


def dangling_refs(records: DataFrame) -> DataFrame:
    """(record_id, ordinal, ref): references of steps to ingredients that the record lacks."""
    ids = ingredient_ids()
    steps = records.select("record_id", F.explode(F.transform("steps", lambda s: F.struct(s["ordinal"].alias("ordinal"), F.array_except(strings(s["ingredient_refs"]), ids).alias("refs")))).alias("s"))
    return steps.select("record_id", "s.ordinal", F.explode("s.refs").alias("ref"))


def ambiguous_aliases(entries: DataFrame) -> DataFrame:
    """(key, ids): alias keys of entries (id, alias) that name more than one id."""
    from .text import lookup_key

    keyed = entries.select("id", lookup_key(F.col("alias")).alias("key")).distinct()
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("ids")).where("ids > 1")


def name_uuid(name: Column, space: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """The version-5 UUID of a name in a name space (by default that of URLs, a fixed value)."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long") % 4 + 8)), -1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
