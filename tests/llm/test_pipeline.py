"""Stages of the corpus pipeline and the registered queries on small tables with everything that may go wrong."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import common, langid, licenses, media, neardup, packing, queries, tokencount

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected string, _n int, _p int, size long, _h string, tags array<string>"
WORDS = {"en": "the house of a river and their garden with some water under old trees".split(), "de": "das haus und der fluss mit einem garten unter alten bäumen am wasser".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", str(rng.randrange(400))]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, prose(rng, lang := ("en", "de")[i % 2], 60), lang, f"s{i % 3}", 1, 0.25, "no", 7, 8, 9, "h", ["t"]) for i in range(60)]
    out.append((3, out[0][1], "en", "s0", 1, 0.25, "no", 7, 8, 9, "h", None))  # an id with a copy of another's text
    out.append((4, out[4][1] + " end", "en", "s1", 1, 0.25, "no", 7, 8, 9, "h", None))  # an id with a near copy
    out.append((None, prose(rng, "en", 50), None, None, None, None, None, None, None, None, None, None))
    out += [out[5], out[5]]  # repeated rows
    out += [(70, None, "en", "s0", 0, 0.5, "x", 1, 1, 1, "", []), (71, "", "en", None, 0, 0.5, "x", 1, 1, 1, "", []), (72, "123 456", "de", "s1", 0, 0.5, "x", 1, 1, 1, "", [])]
    out.append((73, prose(rng, "de", 30_000), "de", "s2", 1, 0.25, "no", 7, 8, 9, "h", ["long"]))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain(r):
    return tuple(tuple(v) if isinstance(v, list) else v for v in r)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_rows_and_columns_stay_as_they_came(spark, table, rows, stage):
    out = stage(spark, table, "")
    assert out.columns == table.columns
    given = Counter(plain(r) for r in rows)
    assert set(plain(r) for r in out.collect()) <= set(given)
    none = stage(spark, table.limit(0), "")
    assert none.columns == table.columns and none.count() == 0


def test_language_stage_drops_only_what_has_no_language(spark, table):
    kept = [r["doc_id"] for r in corpus_pipeline.language_id(spark, table, "").collect()]
    assert not {70, 71, 72} & set(kept) and Counter(kept)[5] == 3 and None in kept and len(kept) == 66
    unlabelled = table.selectExpr("doc_id", "text", "cast(null as string) as lang", "score")
    assert corpus_pipeline.language_id(spark, unlabelled, "").count() == 0


def test_dedup_stage_keeps_one_of_each_class(spark, table, rows):
    kept = Counter(r["text"] for r in corpus_pipeline.near_dedup(spark, table, "").collect())
    assert max(kept.values()) == 1
    texts = {r[1] for r in rows}
    assert texts - set(kept) == {rows[4][1]} or texts - set(kept) == {rows[4][1] + " end"}  # one id, two texts of one class


def test_mixing_stage_takes_sources_near_their_targets(spark, table, rows):
    out = corpus_pipeline.mixing(spark, table, "").collect()
    taken = Counter(plain(r) for r in out)
    given = Counter(plain(r) for r in rows)
    assert all(n <= 2 * given[r] for r, n in taken.items())
    sizes = [len((r[1] or "").encode().split()) for r in rows]
    # a text that is taken in part counts by its half, so the longest may miss by its half
    assert abs(sum(len((r["text"] or "").encode().split()) for r in out) - 1.5 * sum(sizes)) <= 0.05 * sum(sizes) + max(sizes) / 2


def test_the_pipeline_keeps_what_its_stages_should(spark):
    """Over the given documents: nearly all have a language, most are of a class of their own, half as much again is taken."""
    docs = common.documents(spark, SF)
    count, words = docs.count(), lambda df: df.selectExpr("sum(size(split(trim(text), '\\\\s+')))").first()[0]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.stored(stage(spark, docs, SF), name)
        if name == "mixing":
            assert 1.4 <= words(docs) / words(before) <= 1.6
        else:
            assert docs.count() >= 0.5 * count
    out = corpus_pipeline.packing(spark, docs, SF)
    assert out.where("piece = 0").count() == docs.count() > 0


def test_packing_stage_holds_every_piece_once(spark, table, rows):
    out = corpus_pipeline.packing(spark, table, "").collect()
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:] + [(sum(n for _, n in places), 0)]))
        assert sum(n for _, n in places) <= 4096
    assert sum(1 for r in out if r["piece"] == 0) == len(rows)
    assert corpus_pipeline.packing(spark, table.limit(0), "").count() == 0


def test_the_program_places_the_pieces():
    rng = np.random.default_rng(2)
    for times in (1, 500):
        found = dict(zip(*(x.tolist() for x in np.unique(np.clip(rng.lognormal(6, 1, 900).astype(int), 1, 4095), return_counts=True))))
        counts = np.zeros(4097, np.int64)
        for k, n in found.items():
            counts[k] = n * times
        used, left = packing.scaled_program(counts, 4096, 4000)
        again = left.copy()
        for config, many in used:
            assert sum(k * a for k, a in config.items()) <= 4096
            for k, a in config.items():
                again[k] += a * many
        assert (again == counts).all() and (left >= 0).all() and left.sum() <= 0.1 * counts.sum()
        sequences = sum(m for _, m in packing.plan({k: n * times for k, n in found.items()}, 4096))
        assert sequences <= sum(m for _, m in packing.best_fit(counts, 4096)) and sequences >= (counts * np.arange(4097)).sum() / 4096


def test_knapsack_against_all_choices():
    rng = random.Random(5)
    for _ in range(40):
        lengths = np.array(sorted(rng.sample(range(1, 30), 4)))
        offered = np.array([rng.randint(1, 3) for _ in lengths])
        price = np.array([rng.random() for _ in lengths])
        best = 0.0
        for a in np.ndindex(*(offered + 1)):
            if (np.array(a) * lengths).sum() <= 40:
                best = max(best, float((np.array(a) * price).sum()))
        config = packing.dearest(lengths, offered, price, 40)
        at = {int(k): i for i, k in enumerate(lengths)}
        assert abs(sum(price[at[k]] * n for k, n in config.items()) - best) < 1e-9
        assert all(n <= offered[at[k]] for k, n in config.items())


def test_license_windows_against_counting_every_window(spark):
    template = [("L", "grant", " ".join(f"t{i}" for i in range(44)))]
    words = [f"t{i}" for i in range(44)]
    foreign = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    halves = words[:22] + foreign("x", 40) + words[22:]
    twice = words + foreign("y", 40) + words
    edited = words[:20] + ["new"] + words[21:]
    long = foreign("z", 50_000) + words
    rows = [(1, " ".join(halves)), (2, " ".join(twice)), (2, " ".join(twice)), (3, " ".join(edited)), (4, " ".join(long)), (5, None), (6, ""), (7, " ".join(words * 2))]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, start int")
    hits = Counter((r["doc_id"], round(r["containment"], 3)) for r in licenses.scan_licenses(table, template).collect())
    assert hits == Counter({(2, 1.0): 4, (3, 0.875): 1, (4, 1.0): 1, (7, 1.0): 2})
    rng = random.Random(1)
    for _ in range(60):  # the fullest window, by counting each one
        own = np.arange(10, dtype=np.uint64)
        s = np.array([rng.randrange(14) for _ in range(60)], np.uint64)
        full = [len(set(s[i : i + 10].tolist()) & set(range(10))) for i in range(60)]
        found = list(licenses.copies_of(s, own, 0.6))
        assert (max(full) >= 6) == bool(found) and (not found or found[0][2] == max(full) / 10)


def test_counts_of_a_very_long_word():
    from tokenizers.models import Unigram

    vocabulary = tokencount.read_vocabulary(tokencount.vocabulary_path())
    counter = tokencount.PieceCounts(vocabulary)
    model = Unigram([("<unk>", 0.0), *vocabulary], 0, False)
    rng = random.Random(2)
    for n in (1, 50, 3000, 20_000):
        word = "".join(rng.choice("abcdefgh日µ") for _ in range(n))
        assert counter.count(tokencount.START + word) == len(model.tokenize(tokencount.START + word))


def test_labelled_rows_are_chosen_once_each(spark):
    rng = random.Random(8)
    rows = [(None if i % 5 == 0 else i % 7, prose(rng, lang := ("en", "de")[i % 2], 20), lang) for i in range(400)]
    out = langid.identify(spark.createDataFrame(rows + rows[:50] * 4, "doc_id long, text string, lang string"), sample=100)
    found = [(r["lang"], r["lang_pred"]) for r in out.collect()]
    assert len(found) == 600 and sum(a == b for a, b in found) / 600 > 0.97


def test_language_scores_against_one_text_at_a_time():
    rng = random.Random(9)
    rows = [(lang, *langid.counts(prose(rng, lang, 40))) for lang in ("en", "de") * 40]
    model = langid.fit(rows)
    texts = [prose(rng, "en", n) for n in (1, 5, 300)] + ["", "x", "Ünï"]
    together = langid.text_scores(model, [langid.prepared(t) for t in texts])
    for t, row in zip(texts, together):
        at, share = langid.counts(t)
        assert np.allclose(langid.softmax((share @ model.scores[at] + model.bias) * model.scale), row, atol=1e-4)


def planted_images(rng, n=24, side=96):
    """(id, image, original): random smooth pictures, and of the first third a crop, a brighter one and a noisy one."""
    out = []
    for i in range(n):
        cells = rng.normal(128, 60, (12, 12))
        image = np.clip(media.resized(cells, side / 12), 0, 255)
        out.append((4 * i, image, i))
        if i < n // 3:
            out.append((4 * i + 1, image[10:90, 6:88], i))
            out.append((4 * i + 2, np.clip(image * 0.9 + 12, 0, 255), i))
            out.append((4 * i + 3, np.clip(image + rng.normal(0, 4, image.shape), 0, 255), i))
    return out


def test_planted_crops_and_edits_share_a_class(spark):
    planted = [(i, np.rint(im).astype(np.uint8), o) for i, im, o in planted_images(np.random.default_rng(4))]
    rows = [(i, im.shape[0], im.shape[1], bytearray(im.tobytes()), "x", 0) for i, im, _ in planted]
    flat = bytearray(b"\x07" * 4096)
    rows += [(900, 64, 64, flat, "x", 0), (901, 64, 64, flat, "x", 0), (None, 64, 64, flat, "x", 0), (902, 64, 64, None, "x", 0), (903, 5, 5, flat, "x", 0), rows[0]]
    table = spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary, class_id string, links int")
    out = media.image_copies(table).collect()
    assert len(out) == len(rows)
    found = {r["image_id"]: r["class_id"] for r in out}
    pairs = [(a, b) for a, _, o in planted for b, _, p in planted if a < b and o == p]
    assert sum(found[a] == found[b] for a, b in pairs) / len(pairs) >= 0.9
    assert not any(found[a] == found[b] for a, _, o in planted for b, _, p in planted if a < b and o != p)
    assert found[900] == found[901] == 900 and found[902] == 902 and found[903] == 903
    assert next(r for r in out if r["image_id"] == 0)["copies"] == 2
    # every image against every other by all corners: what the tables find is nearly all of it
    corners = {i: media.describe(im) for i, im, _ in planted}
    true = [(a, b) for a in corners for b in corners if a < b and media.consensus(corners[a], corners[b], 4, 20)]
    assert sum(found[a] == found[b] for a, b in true) / len(true) >= 0.9
    assert media.image_copies(table.limit(0)).count() == 0


def test_similar_texts_of_all_pairs_share_a_class(spark):
    """Texts with up to a tenth of their words changed, against the alignment of all pairs."""
    rng = random.Random(21)
    given = []
    for family in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(3):
            changed = list(words)
            for at in rng.sample(range(120), rng.randint(0, 8)):
                changed[at] = f"n{rng.randrange(10**6)}"
            given.append((len(given), " ".join(changed)))
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    words = [neardup.word_hashes(t).astype(np.uint32) for _, t in given]
    pairs = [(a, b) for b in range(len(given)) for a in range(b) if neardup.aligned(words[a], words[b], 0.8)]
    # bands find pairs by their k-mers, of which these share less than half: 52 of 59 as measured
    assert len(pairs) >= 50 and sum(found[a] == found[b] for a, b in pairs) / len(pairs) >= 0.85
    assert all(a // 3 == b // 3 for a, b in pairs) and len(set(found.values())) >= 25


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_gives_rows(spark, name):
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert out.limit(3).count() == 3
