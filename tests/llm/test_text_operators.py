"""Phrases, alignment and secrets against brute force on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import alignment, phrases, secrets

# ---- phrases -------------------------------------------------------------------------------------------------------


def counted_plainly(rows, least, first):
    grams, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                grams[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in grams.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for q, b in candidates.items():
            for m in range(2, len(q)):
                covered |= {q[i : i + m] for i in range(len(q) - m + 1) if 100 * b >= 80 * f[q[i : i + m]]}
        ranked = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def chatter():
    rng = random.Random(4)
    words = "The of and to In river Été stone a b c ÄB ab".split()
    rows = []
    for i in range(300):
        said = " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", ";x", "\t", "  "]) for _ in range(rng.randint(1, 60)))
        rows.append((i, said + rng.choice(["", " new york city hall", " New York city", "\nde facto"]), rng.choice(["en", "fr", None])))
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, " .;\n\t", "de"), (None, "once", None), rows[0], rows[0], (1003, "ab " * 3000, "en"), (1004, "w" * 9000 + " to " * 40, "fr")]
    return rows


def test_phrases_against_counting_all(spark, chatter, monkeypatch):
    table = spark.createDataFrame([(*r, 1, "p") for r in chatter], "doc_id long, text string, lang string, n long, phrase string").repartition(4)
    expected = counted_plainly(chatter, 30, 2000)
    own = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, phrases.collocations(table).select(own).collect())) == expected and len(expected) >= 15
    assert sorted(map(tuple, phrases.collocations(table, least=5, first=7).select(own).collect())) == counted_plainly(chatter, 5, 7)
    assert phrases.collocations(table.limit(0)).count() == 0


def test_long_texts_in_parts_and_ranges_give_the_same_counts(chatter):
    """Tries of texts cut in small parts, split at many cuts and put together again, hold what one trie holds."""
    rng = random.Random(6)
    for most in (20, 64, 1 << 22):
        for depths in ((1, 2), (3, 4)):
            whole, shard = Counter(), phrases.Shard()
            for _, text, _ in chatter[:60]:
                for words, ahead in phrases.parts(text or "", most):
                    shard.add(words, ahead)
                (words, ahead), *rest = phrases.parts(text or "")
                assert not ahead and not rest
                run = []
                for w in [*words, phrases.BREAK]:
                    if w == phrases.BREAK:
                        for m in range(depths[0], depths[1] + 1):
                            whole.update(tuple(run[i : i + m]) for i in range(len(run) - m + 1))
                        run = []
                    else:
                        run.append(w)
            blocks, n = shard.built("en", depths, None)
            found = Counter()
            for block in blocks:
                names = [(v, b"") if rng.random() < 0.3 else (v, rng.choice(block.vocab)) for v in block.vocab[::3]] + [(b"zzz", b"zz")]
                last = -1
                for r, part in block.split(sorted(set(names))):
                    assert r > last
                    last = r
                    for path, k in zip(*part.paths()):
                        p = tuple(part.vocab[i - 1] for i in path if i)
                        low, high = sorted(set(names))[r - 1] if r else (b"", b""), sorted(set(names))[r] if r < len(set(names)) else (b"\xff", b"")
                        assert low <= (*p, b"")[:2] < high
                        found[p] += int(k)
            assert found == whole and n == sum(len([w for w in words if w != phrases.BREAK]) for _, t, _ in chatter[:60] for words, _ in phrases.parts(t or ""))


# ---- alignment -----------------------------------------------------------------------------------------------------

ODD = ["", None, " ", "  ", "\n", " a", "a ", "a  b", "a\n\nb", "a \n b", "a\n b\n", "▁x", "x ▁ y", "tab\there", "\n\n x", "<s> hi </s> <|endoftext|> z", "日本語 テキスト\n中文", "😀😀 👩‍👩‍👧 é é", "a\x00b \x1c c", "a b   c d", "x" * 3000, "ab " * 500, "é" * 1500, "don't it's 12345 3.14  \t  end", " \n \n", "a\r\nb\r\n c", "word\n\tx", "q\n\x1cz", "same text", "same text"]


def test_alignment_against_one_token_at_a_time(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("the Münchner river.\nNew  tokens: 42 àé unbelievable".split(" ")) for _ in range(rng.randint(1, 50))) for _ in range(60)]
    a_model, b_model = alignment.ByteLevel(alignment.vocabulary("byte_bpe_50k.json")), alignment.Pieces(alignment.vocabulary("piece_bpe_32k.model"))
    plain, linked = [], []
    for text in texts:
        a = a_model.model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.model.encode(text) if text else []
        given = (" " + (text or "")).encode()
        groups, links = [], Counter()
        if text and b"".join(a_model.bytes[i] for i in a) == given == b"".join(b_model.bytes[i] for i in b):
            ends = [set(np.cumsum([len(m.bytes[i]) for i in ids]).tolist()) for m, ids in ((a_model, a), (b_model, b))]
            left, right, at_a, at_b = iter(a), iter(b), 0, 0
            for cut in sorted(ends[0] & ends[1]):
                x, y = [], []
                while at_a < cut:
                    x.append(next(left))
                    at_a += len(a_model.bytes[x[-1]])
                while at_b < cut:
                    y.append(next(right))
                    at_b += len(b_model.bytes[y[-1]])
                groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
                links.update((u, v) for u in x for v in y)
        else:
            a = b = []
        plain.append((len(a), len(b), len(groups), links.total(), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        linked.append(links)
    count = Counter(p for links in linked for p in links)
    best = Counter()
    for (u, _), n in count.items():
        best[u] = max(best[u], n)
    expected = [(i, *p[:4], sum(k for q, k in ls.items() if count[q] == best[q[0]]), sum(k * count[q] for q, k in ls.items()), p[4]) for i, (p, ls) in enumerate(zip(plain, linked))]
    table = spark.createDataFrame([(i, t, 9, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_a long, chunk long")
    assert sorted(map(tuple, alignment.align(table.repartition(3)).collect())) == expected
    assert alignment.align(table.limit(0)).count() == 0
    assert sorted(r["n_a"] for r in alignment.align(table.selectExpr("cast(null as long) as doc_id", "text")).collect()) == sorted(e[1] for e in expected)


def test_small_bounds_change_nothing(monkeypatch):
    """A large group by its distinct ids, segments forgotten after each batch."""
    paths = alignment.vocabulary("byte_bpe_50k.json"), alignment.vocabulary("piece_bpe_32k.model")
    texts = [t or "" for t in ODD]

    def told():
        chunk, known = alignment.Chunk(), alignment.Segments(*paths)
        for i in range(0, len(texts), 4):
            chunk.add(list(range(i, min(i + 4, len(texts)))), texts[i : i + 4], known)
        return chunk.row().drop_columns(["chunk"])

    once = told()
    monkeypatch.setattr(alignment, "GROUP_PAIRS", 1)
    monkeypatch.setattr(alignment, "KEPT_SEGMENTS", 1)
    monkeypatch.setattr(alignment, "JOINED", 2)
    assert told().equals(once)


def test_ranks_of_a_bitset():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 9, 500)
    marks = alignment.Bitset.of_lengths(lengths, int(lengths.sum()))
    ends = np.cumsum(lengths) - 1
    assert (marks.places() == ends).all()
    at = np.arange(lengths.sum())
    assert (marks.rank(at) == np.searchsorted(ends, at, side="right")).all()


# ---- secrets -------------------------------------------------------------------------------------------------------


def test_base_spans_against_the_patterns_as_stated(spark):
    rng = random.Random(2)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "apikey", " ", "  ", "=", ":", '"', "'", "AKIA", "AKIAABCDEFGHIJKLMN", "ABC123", "deadbeef", "0123456789abcdef", "x", "ſecret", "toKen", "é", "\n", "/+.=-_", "hunter2hunter2"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(800)] + [None, "", "token = secret = abcdefghijklmnop", 'Api_Key": "abcdefghijkl"']
    letters = r"(?ai:(password|passwd|secret|token|api_?key))"
    assign = re.compile(letters + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    expected = []
    for i, text in enumerate(texts):
        text = text or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
        expected.append([(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)])
    table = spark.createDataFrame([(i, t, 1, "n") for i, t in enumerate(texts)], "doc_id long, text string, spans long, kind string").repartition(3)
    got = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] for r in secrets.scan_secrets(table).collect()}
    assert [[s for s in got[i] if s[0] != "literal"] for i in range(len(texts))] == expected
    assert sum(map(len, expected)) > 200 and all(len(e) for k in (0, 1, 2) for e in [[1 for x in expected for s in x if s[0] == secrets.KINDS[k]]])
    assert secrets.scan_secrets(table.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, found",
    [
        ('k = "hunter2hunter2Xq"\npassword = k', ["hunter2hunter2Xq"]),
        ('password = k\nk = "hunter2hunter2Xq"', ["hunter2hunter2Xq"]),
        ('a="one1 two2 x"\nb = a\nb2 = b\napi_secret: str = b2\na="later 1 ignored"', ["one1 two2 x"]),
        ('{"db": {"password": "p@ss w0rd 123"}}', ["p@ss w0rd 123"]),
        ("export X='ab cd 12 34'\nexport DB_PASSWORD=${X}", ["ab cd 12 34"]),
        ('A="abcd 1234"\nB="efgh 5678"\nclientSecret = A + B', ["abcd 1234", "efgh 5678"]),
        ("<password>s3cr3t pass</password>", ["s3cr3t pass"]),
        ("password: Mystr0ng!Pass#9", ["Mystr0ng!Pass#9"]),
        ('val apiKey: String = SecretStr("zz99 yy88 xx77")', ["zz99 yy88 xx77"]),
        ('const dbPass = process.env.DB || "Tr0ub4dor&3"', ["Tr0ub4dor&3"]),
        ('a = b = password = "x Y9 z8w7v6"', ["x Y9 z8w7v6"]),
        ('token = get(\n "a b 1 c d 2"\n)', ["a b 1 c d 2"]),
        ("don't password = 'hello wörld 99'", ["hello wörld 99"]),
        ("the token: something happened here today", []),
        ('passwordLength = "abcdefgh123 x"', []),
        ('password = "changeme"', []),
        ('a = b\nb = a\npassword = a', []),
        ("monkey = 'a b c d 1 2 3'", []),
        ('color = "a b c d 1 2 3 4 5"', []),
        ("password =", []),
        ("", []),
    ],
)
def test_literals_by_target_names(text, found):
    assert [text[a:b] for a, b, _, _ in secrets.scored(text)] == found


def test_literals_come_beside_the_base(spark):
    rows = [(1, 'x = "ab cd 12 34"\nsecret = x\ntoken = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (None, None), (1, "clean text: nothing"), (2, 'password = "' + "y" * 100_000 + '"')]
    out = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = [[(s["kind"], s["name"]) for s in r["spans"]] for r in out]
    assert sorted(spans, key=len)[:2] == [[], []] and [("literal", "secret"), ("assign", None), ("hex", None)] in spans
    assert [("assign", None)] in spans


def test_constants_do_not_blow_up():
    doubled = 'a0 = "q1w2e3r4 t5"\n' + "".join(f"a{i} = a{i - 1} + a{i - 1}\n" for i in range(1, 60)) + "password = a59"
    assert [doubled[a:b] for a, b, _, _ in secrets.scored(doubled)] == ["q1w2e3r4 t5"]
    chain = 'token = "z9 y8 x7 w6"\n' + "".join(f'token = token + "{i * 7919 % 9973:x}Qz"\n' for i in range(3000))
    assert len(secrets.scored(chain)) == 3001
