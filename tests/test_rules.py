"""Rules over nested records, ordered duplicates, constraints in texts and rankings, on small fixtures."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.functions import constraints, ranking, records, text
from millrace.operators import similarity

GOOD = {
    "record_id": 1, "name": "Soup", "summary": "plain", "aliases": ["broth"], "ingredients": [("i1", "leek", "REQUIRED"), ("i2", "salt", "OPTIONAL")],
    "steps": [(1, "cut leek", "PREPARE", "PREP", 5.0, None, ["i1"], ["KNIFE"], None), (2, "boil", "BOIL", "COOK", 20.0, 100.0, ["i1", "i2"], ["POT"], "hot")],
    "equipment": (["KNIFE"], ["POT"]), "total_minutes": 25.0, "nutrition": (None, None, None, None, "UNKNOWN", None), "scenario": ["quick"], "license": "free", "reliability": 1.0,
}
FIELDS = list(GOOD)


def table(spark, *changes):
    rows = [{**GOOD, "record_id": i, **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], records.SCHEMA)


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([("i1", "leek"), ("i2", "salt")], "id string, name string")


def test_each_rule_gives_its_issue(spark, catalog):
    cases = [
        ({}, set()),
        ({"ingredients": [("i1", "lek", "REQUIRED"), ("i2", "salt", None)]}, {("INGREDIENT_CATALOG_MISMATCH", "ingredients[0]")}),
        ({"ingredients": [("i2", "salt", "OPTIONAL"), ("i1", "leek", "REQUIRED")], "steps": [(1, "boil", "BOIL", "COOK", 1.0, None, ["i2"], [], None)]}, {("REQUIRED_INGREDIENT_UNUSED", "ingredients[1]")}),
        ({"steps": [(1, "x", "BOIL", "COOK", 1.0, None, ["i1", "i9"], [], None)]}, {("UNKNOWN_STEP_INGREDIENT", "steps[0].ingredient_refs")}),
        ({"steps": [(2, "x", "BOIL", "COOK", 1.0, None, ["i1"], None, None)]}, {("STEP_ORDER_INVALID", "steps")}),
        ({"steps": [(1, "x", "BOIL", "COOK", 1.0, 351.0, ["i1"], ["OVEN"], None)]}, {("STEP_EQUIPMENT_UNDECLARED", "steps[0].equipment_refs"), ("IMPLAUSIBLE_TEMPERATURE", "steps[0].temperature_celsius")}),
        ({"total_minutes": 16.0}, {("STEP_TIME_MISMATCH", "time.total_minutes")}),
        ({"summary": "Raw Chicken that can CURE cancer"}, {("UNSAFE_COOKING_INSTRUCTION", "steps"), ("UNSUPPORTED_MEDICAL_CLAIM", "identity.summary")}),
        ({"nutrition": (2001.0, None, 251.0, None, None, None)}, {("IMPLAUSIBLE_CALORIES", "nutrition.calories_kcal"), ("IMPLAUSIBLE_MACRONUTRIENT", "nutrition")}),
        ({"nutrition": (100.0, 50.0, 10.0, 20.0, None, None)}, {("NUTRITION_CALORIE_MISMATCH", "nutrition")}),
        ({"ingredients": None, "steps": None}, set()),
    ]
    found = {}
    for r in records.issues(table(spark, *(c for c, _ in cases)), catalog).collect():
        found.setdefault(r["record_id"], set()).add((r["code"], r["path"]))
    assert [found.get(i, set()) for i in range(len(cases))] == [e for _, e in cases]


def test_quality_gate(spark, catalog):
    given = table(spark, {}, {"reliability": 0.4}, {"summary": "raw chicken"}, {"reliability": 0.0, "total_minutes": 16.0})
    repeated = spark.createDataFrame([(1,)], "record_id long")
    out = {r["record_id"]: r for r in records.quality(given, records.issues(given, catalog)).collect()}
    full = 0.8 + 0.2 * 3 / 7
    assert out[0]["score"] == round(0.3 + 0.15 * full + 0.55, 4) and out[0]["status"] == "PUBLISHED"
    assert out[1]["status"] == "REVIEW" and out[2]["status"] == "REJECTED" and out[2]["safety"] == 0.5
    assert out[3]["step_consistency"] == 0.85 and out[3]["status"] == "REJECTED"
    again = {r["record_id"]: r["status"] for r in records.quality(given, records.issues(given, catalog, repeated)).collect()}
    assert again[1] == "REJECTED" and again[0] == "PUBLISHED"


def test_audit_and_concerns(spark):
    meat = [("i1", "鸡肉", "REQUIRED")]
    step = [(1, "切", "PREPARE", "PREP", 1.0, None, ["i1"], [], None)]
    given = table(spark, {}, {"ingredients": meat, "steps": step}, {"total_minutes": 4.0}, {"summary": "Detox", "nutrition": (1.0, None, None, None, None, None), "ingredients": [("i1", "鲈鱼", None)]})
    out = {r["record_id"]: r for r in records.audit(given).collect()}
    assert out[0]["decision"] == "AUDIT_PASSED" and out[0]["score"] == 1.0 and not out[0]["safety_sensitive"]
    assert out[1]["issue_codes"] == ["FOOD_SAFETY_CUE_MISSING", "COOKING_STAGE_MISSING"] and out[1]["score"] == 0.64 and out[1]["decision"] == "REJECTED"
    assert out[2]["decision"] == "FLAGGED" and out[3]["issue_codes"][:2] == ["UNSUPPORTED_CLAIM", "UNVERIFIED_SYNTHETIC_NUTRITION"]
    found = {}
    for r in records.concerns(given).collect():
        found.setdefault(r["record_id"], set()).add(r["concern"])
    assert 0 not in found and found[1] == {"TOO_FEW_INGREDIENTS", "TOO_FEW_EXECUTABLE_STEPS", "NO_COOKING_METHOD", "POULTRY_DONENESS_UNCLEAR"}
    assert found[3] == {"TOO_FEW_INGREDIENTS", "UNVERIFIED_SYNTHETIC_NUTRITION", "FISH_DONENESS_UNCLEAR"}


def test_references_aliases_and_ids(spark):
    refs = records.dangling_refs(table(spark, {}, {"steps": [(1, "x", "BOIL", "COOK", 1.0, None, ["i1", "i9"], [], None)]})).collect()
    assert [tuple(r) for r in refs] == [(1, 1, "i9")]
    entries = spark.createDataFrame([("a", "Red Onion"), ("b", "red_onion"), ("a", "leek")], "id string, alias string")
    assert [tuple(r) for r in records.ambiguous_aliases(entries).collect()] == [("redonion", 2)]
    names = ["x", "ai:item:番茄", "", "Ünï"] + [str(i) for i in range(40)]
    out = spark.createDataFrame([(n,) for n in names], "n string").select("n", records.name_uuid(F.col("n")).alias("id")).collect()
    assert all(r["id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in out)


def accepted_slowly(rows, links, baseline):
    known, out = list(baseline), {}
    for ordinal, name in sorted(rows):
        match = next((k for k, other in sorted(known) if (name is not None and other == name) or (k, ordinal) in links), None)
        out[ordinal] = match
        if match is None:
            known.append((ordinal, name))
    return out


def test_first_accepted_against_one_record_at_a_time(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(5)
    for turn in range(4):
        rows = [(i, rng.choice(["a", "b", None] + [f"n{i}"] * 4)) for i in range(40)]
        base = [(-3, "a"), (-2, "z")] if turn % 2 else []
        links = {tuple(sorted(rng.sample(range(-3 if base else 0, 40), 2))) for _ in range(35)}
        links = {(a, b) for a, b in links if b >= 0 and a not in (-1,)}
        out = similarity.first_accepted(spark.createDataFrame(rows, "ordinal long, name string"), spark.createDataFrame(sorted(links), "left_id long, right_id long"), spark.createDataFrame(base, "ordinal long, name string"))
        assert {r["ordinal"]: r["duplicate_of"] for r in out.collect()} == accepted_slowly(rows, links, base)
    many = spark.range(300).select(F.col("id").alias("ordinal"), F.lit("same").alias("name"))
    out = similarity.first_accepted(many, spark.createDataFrame([], "left_id long, right_id long")).collect()
    assert sum(r["duplicate_of"] == 0 for r in out) == 299


def test_set_pairs_with_empty_sets_and_exact_prefixes(spark):
    rows = [(1, []), (2, []), (3, None), (4, [f"a{i}" for i in range(20)]), (5, [f"a{i}" for i in range(11)])]
    df = spark.createDataFrame(rows, "id long, elements array<string>")
    assert {(r[0], r[1]) for r in similarity.set_pairs(df, [], 0.55).collect()} == {(1, 2), (1, 3), (2, 3), (4, 5)}


def test_review_ladder(spark):
    rows = [(1, 2, True, 0.5, 0.1, 0.0), (1, 3, False, 0.55, 0.8, 1.0), (1, 4, False, 0.5, 0.7, 1.0), (1, 5, False, 0.8, 0.0, 0.0), (1, 6, False, 0.44, 0.49, 1.0), (1, 7, False, 0.5, 0.5, 0.5)]
    out = similarity.reviewed(spark.createDataFrame(rows, "left_id long, right_id long, same_name boolean, name double, ingredients double, methods double"))
    assert {r["right_id"]: r["decision"] for r in out.collect()} == {2: "REJECT_RIGHT", 3: "REJECT_RIGHT", 4: "HUMAN_REVIEW", 5: "HUMAN_REVIEW"}
    assert sorted(r["id"] for r in similarity.rejected_ids(out).collect()) == [2, 3]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens_of_any_script(spark):
    assert one(spark, "Rice_1 番茄炒蛋 x 蛋", text.tokens) == ["rice_1", "x", "番茄", "茄炒", "炒蛋", "番茄炒", "茄炒蛋"]
    assert one(spark, "a_b 番茄番茄", text.simple_terms) == ["a", "b", "番茄", "茄番"]
    assert one(spark, "Red-番茄 1!", text.plain_name) == "red番茄1"
    assert one(spark, "Pea nuts", lambda c: text.aliased_key(c, {"peanuts": "peanut"})) == "peanut"


def test_constraints_in_text(spark):
    names = ["onion", "red onion", "番茄", "milk"]
    assert one(spark, "Red onion, onions and 番茄汤 with MILK", lambda c: constraints.mentions(c, names)) == ["Red onion", "MILK", "番茄"]
    texts = spark.createDataFrame([(1, "soup without milk or onion. more milk"), (2, "不要番茄，加 milk"), (3, "I have a milk allergy")], "id long, t string")
    out = {(r["id"], r["value"]) for r in constraints.excluded_mentions(texts, "id", "t", names).collect()}
    assert out == {(1, "milk"), (1, "onion"), (2, "番茄"), (3, "milk")}
    oven = lambda c: constraints.polarity(c, ["oven", "烤箱"], ("no ", "没有"), (" is broken",))
    assert [one(spark, t, oven) for t in ("use the oven", "no oven here", "家里没有烤箱", "oven is broken", "pan")] == ["available", "unavailable", "unavailable", "unavailable", None]
    assert one(spark, "for 4 servings", lambda c: constraints.number(c, constraints.SERVINGS)) == 4 and one(spark, "x", lambda c: constraints.number(c, constraints.MINUTES)) is None
    asks = lambda c: constraints.asks(c, "recipe|how to cook", "not? (?:want )?a recipe")
    assert one(spark, "how to cook rice", asks) and not one(spark, "I do not want a recipe", asks)


def test_histories_and_merging(spark):
    rows = spark.createDataFrame([(1, 1, ["b", "a"], 5), (1, 2, ["a", "c"], None), (1, 3, [], 7), (2, 1, None, None)], "k long, turn long, v array<string>, n int")
    assert {r["k"]: r["v"] for r in constraints.ordered_values(rows, "k", "turn", ["v"]).collect()} == {1: ["b", "a", "c"], 2: []}
    assert {r["k"]: r["n"] for r in constraints.last_values(rows, "k", "turn", ["n"]).collect()} == {1: 7, 2: None}
    df = spark.createDataFrame([(["A", "b"], ["b", "c"], ["a"], 3, None)], "s array<string>, e array<string>, m array<string>, x int, y int")
    out = df.select(constraints.merged(F.col("s"), F.col("e"), F.col("m")).alias("v"), constraints.enforced_first(F.col("x"), F.col("y")).alias("n")).first()
    assert out["v"] == ["b", "c"] and out["n"] == 3
    names = spark.createDataFrame([(1, 1, "leek"), (1, 2, "porree"), (1, 3, "xyz")], "query_id long, ordinal int, key string")
    keys = lambda *r: spark.createDataFrame(list(r), "key string, id string")
    assert {(r["id"], r["ordinal"]) for r in constraints.resolved(names, keys(("leek", "i1")), keys(("porree", "i1"), ("leek", "i9"))).collect()} == {("i1", 1), ("unknown:xyz", 3)}


def test_scores_and_explanations(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    c = {
        "item_parts": a("leek", "salt"), "query_parts": a("leek"), "item_scenarios": a("quick"), "query_scenarios": a("quick", "party"), "item_terms": a("leek", "soup"),
        "query_terms": a("soup", "hot"), "dish_terms": a("soup"), "item_name": F.lit("Leek Soup"), "query_text": F.lit("hot leek-soup please"), "minutes": F.lit(20), "max_minutes": F.lit(50),
        "preference": F.lit(0.5), "quality": F.lit(0.9),
    }
    row = spark.range(1)
    assert row.select(ranking.rule_score(c).alias("s")).first()["s"] == round(8 + 3 + 5 + 2 + 3 + 3 + 1 + 1.5 + 0.5 + 0.009, 6)
    late = c | {"max_minutes": F.lit(10), "query_parts": a(), "preference": F.lit(None).cast("double")}
    assert row.select(ranking.rule_score(late).alias("s")).first()["s"] == round(5 + 2 + 3 - 1 + 0.5 + 0.009, 6)
    assert row.select(ranking.preference_match({"x": F.lit(1.0), "y": F.lit(0.0)}, a("x", "y")).alias("s")).first()["s"] == 0.5
    out = row.select(ranking.explained(a("leek", "rice"), a("leek", "salt"), a("salt"), a("quick"), F.lit(30), a(), F.lit(True)).alias("e")).first()["e"]
    assert out["why"] == ["multilingual semantic match", "matched ingredients: leek", "matched scenario: quick", "within 30 minute limit", "non-spicy constraint satisfied"]
    assert out["matched"] == ["leek"] and out["missing"] == ["salt"]
