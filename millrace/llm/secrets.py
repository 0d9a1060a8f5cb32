"""Operator 13: secret scans by assignment-aware lexing.

Three fixed patterns give the base spans. The method reads a text as source or configuration: a lexer cuts it into
names, strings, references and signs; a parser pairs each assigned name (``name = "x"``, ``"name": "x"``, ``name: x``,
``<name>x</name>``, with type notes, calls around the value and joined strings) with the literals of its value.
A value that refers to another name (``b = a``, ``${A}``) takes over that name's literals: the last ones assigned
before, else the first ones after. Each value is scored by its target name (how sensitive its words are) times how
much it looks like a secret; the literals of a value that reaches the threshold are spans of kind ``literal``,
wherever they stand, so a constant with a harmless name is found where a sensitive name takes it over.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

# The patterns of the base kinds, in the order of kinds at one start.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 and more is a match of HEX that passes, and the other way round
#: What a text must have for any match; linear scans over a whole batch that leave few texts to look at.
MAY_HOLD = {"assign": "(?i)" + ASSIGN.replace("+)", "{12})"), "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}

#: Words of a name and how sensitive they make it; of several the highest counts, `key` only with a word before it.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "auth": 0.6, "bearer": 0.8, "jwt": 0.8}
KEY_OF = {"api", "access", "private", "secret", "signing", "encryption", "master", "auth", "service", "account", "deploy", "ssh", "client"}
#: Words after which a name tells about a secret and is none.
ABOUT = {"count", "length", "len", "type", "name", "names", "url", "uri", "path", "file", "id", "ids", "expiry", "ttl", "size", "limit", "field", "hint", "label", "policy", "regex", "pattern", "min", "max", "index", "format", "prompt"}
#: Values that stand for a secret and are none.
PLACEHOLDERS = re.compile(r"(?i)^(change.?me|example.*|your.*|placeholder|todo|none|null|nil|true|false|undefined|redacted|dummy|test|password|secret|token|<.*>|\*+|x+|\.+|-+|%s|\{.*\})$")
THRESHOLD = 0.5

TOKEN = re.compile(
    r"""(?P<space>[^\S\n]+|\\\n)
    |(?P<line>\n)
    |(?P<string>\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3}|"(?:[^"\\\n]|\\.)*"|(?<!\w)'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
    |(?P<ref>\$\{[A-Za-z_][\w.]*\}|\$[A-Za-z_]\w*|%[A-Za-z_]\w*%)
    |(?P<tag></?[A-Za-z_][\w.:-]*>)
    |(?P<name>[^\W\d]\w*(?:[.-][^\W\d]\w*)*)
    |(?P<sign>:=|=>|[=!<>]=|\.\.|\|\||\?\?|[=:+,;(){}\[\].&|?])
    |(?P<other>.)""",
    re.VERBOSE,
)
BARE = re.compile(r"""[^\s"'`,;<>(){}\[\]]+""")
GIVES = {"=", ":", ":=", "=>"}
JOINS = {"+", "..", "&", ".", "||", "??"}
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: A value may be made of values of values; chains of names longer than this are not followed.
CHAIN = 64


class Piece(NamedTuple):
    start: int
    stop: int
    text: str


class Value(NamedTuple):
    name: str
    at: int
    parts: list  # Piece, or (name, place) of a reference


def sensitivity(name: str) -> float:
    """0 to 1: how sensitive what the name holds is, by its words (snake, kebab, dotted or camel case)."""
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    if not words or words[-1] in ABOUT:
        return 0.0
    score = max(SENSITIVE.get(w, 0.0) for w in words)
    if words[-1] == "key" and len(words) > 1:
        score = max(score, 0.9 if KEY_OF & set(words[:-1]) else 0.4)
    return score


def strength(text: str, bare: bool) -> float:
    """0 to 1: how much a value looks like a secret: long enough, no placeholder, kinds and spread of its characters.

    An unquoted value must have digits and letters, or prose after a colon would count.
    """
    if len(text) < 8 or PLACEHOLDERS.match(text):
        return 0.0
    digits, letters = any(c.isdigit() for c in text), any(c.isalpha() for c in text)
    if (bare and not (digits and letters)) or "://" in text or (text.startswith(("/", "./")) and not digits):
        return 0.0
    n = len(text)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(text).values())
    kinds = digits + any(c.islower() for c in text) + any(c.isupper() for c in text) + any(not c.isalnum() for c in text)
    return min(1.0, 0.25 * min(bits, 4.0) * (0.7 + 0.1 * kinds))


def unquoted(start: int, raw: str) -> Piece:
    width = 3 if raw[:3] in ('"""', "'''") and len(raw) >= 6 else 1
    return Piece(start + width, start + len(raw) - width, raw[width : len(raw) - width])


def lexed(text: str) -> list[tuple[str, int, str]]:
    return [(m.lastgroup, m.start(), m.group()) for m in TOKEN.finditer(text)]


def parsed(text: str) -> list[Value]:
    """All pairs of an assigned name and its value's parts, in order of their places."""
    tokens = lexed(text)
    n, out = len(tokens), []

    def after(i: int) -> int:
        while i < n and tokens[i][0] == "space":
            i += 1
        return i

    def value(i: int) -> tuple[list, int]:
        """Parts of the value that starts at token i, and the token behind it."""
        parts, depth, wanted = [], 0, True
        while (i := after(i)) < n:
            kind, at, raw = tokens[i]
            if kind == "string":
                parts.append(unquoted(at, raw))
                wanted = False
            elif kind == "ref":
                if not wanted:
                    break
                parts.append((raw.strip("${}%"), at))
                wanted = False
            elif kind in ("name", "other") and wanted:
                following = after(i + 1)
                if kind == "name" and following < n and tokens[following][2] == "(" and tokens[following][1] == at + len(raw):
                    depth, i = depth + 1, following  # a call around the value
                else:
                    bare = BARE.match(text, at)
                    if not bare:
                        break
                    end = bare.end()
                    if kind == "name" and end == at + len(raw):
                        parts.append((raw, at))
                        if depth == 0:
                            parts.append(Piece(at, end, raw))
                    elif depth == 0 and not parts:
                        parts.append(Piece(at, end, bare.group()))
                    while i + 1 < n and tokens[i + 1][1] < end:
                        i += 1
                    wanted = False
            elif raw == "(" and wanted:
                depth += 1
            elif raw == ")" and depth:
                depth -= 1
            elif raw in JOINS or (depth and raw == ","):
                wanted = True
            elif kind == "line" and depth:
                pass
            else:
                break
            i += 1
        return parts, i

    i = 0
    while i < n:
        kind, at, raw = tokens[i]
        following = after(i + 1)
        sign = tokens[following][2] if following < n else ""
        if kind == "tag" and not raw.startswith("</"):
            close = f"</{raw[1:-1]}>"
            end = text.find("<", at + len(raw))
            if end > 0 and text.startswith(close, end):
                held = text[at + len(raw) : end]
                left = at + len(raw) + len(held) - len(held.lstrip())
                out.append(Value(raw[1:-1], at, [Piece(left, left + len(held.strip()), held.strip())]))
            i += 1
            continue
        name = raw if kind == "name" else unquoted(at, raw).text if kind == "string" and len(raw) < 80 else None
        if name and sign == ":" and kind == "name":  # a note of the type between name and value
            noted = after(following + 1)
            given = after(noted + 1)
            if given < n and tokens[noted][0] == "name" and tokens[given][2] == "=":
                following, sign = given, "="
        if name and sign in GIVES:
            parts, behind = value(following + 1)
            if parts:
                out.append(Value(name, at, parts))
            # a value may be a name that is assigned itself: a = b = "x"
            i = following + 1 if len(parts) and not isinstance(parts[0], Piece) else max(behind, following + 1)
            continue
        i += 1
    return out


def scored(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, stop, name, score) of each literal that reaches the threshold, for the name that scores highest."""
    values = parsed(text)
    known, places = defaultdict(list), defaultdict(list)
    for v in sorted(values, key=lambda v: v.at):
        known[v.name].append(v)
        places[v.name].append(v.at)

    def literals(v: Value, seen: set, depth: int = 0) -> list[Piece]:
        """The value's literals; a name that is known gives its own, one that is not stands for itself."""
        out, taken = [], -1
        seen.add(v.at)
        for part in v.parts:
            if isinstance(part, Piece):
                if part.start != taken:
                    out.append(part)
                continue
            name, at = part
            if name in known and depth < CHAIN:
                i = bisect_left(places[name], v.at) - 1
                source = known[name][i] if i >= 0 else next((x for x in known[name] if x.at > v.at), None)
                if source:
                    taken = at
                    if source.at not in seen:
                        out += literals(source, seen, depth + 1)
        return out

    best: dict[tuple[int, int], tuple[float, str]] = {}
    for v in values:
        sensitive = sensitivity(v.name)
        if not sensitive:
            continue
        pieces = literals(v, set())
        quoted = [p for p in pieces if p.start and text[p.start - 1] in "\"'`>"]
        bare, pieces = not quoted, quoted or pieces  # beside strings, an unknown name is a name
        whole = "".join(p.text for p in pieces)
        score = sensitive * strength(whole, bare)
        if score >= threshold:
            for p in pieces:
                if p.text:
                    best[p.start, p.stop] = max(best.get((p.start, p.stop), (0.0, "")), (score, v.name))
    return sorted((start, stop, name, score) for (start, stop), (score, name) in best.items())


def base_spans(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, int]]:
    """(start, number of the kind, stop) of the base matches that pass, in order."""
    out = []
    if "assign" in kinds:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "access" in kinds:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if "hex" in kinds:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


#: Where no such word stands before an assignment sign, no name is sensitive.
MAY_ASSIGN = r"(?i)(pass|pwd|secret|token|credential|key|auth|bearer|jwt)[\w.\-]*([\"'`]?\s*(=|:)|>)"

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())]))


def scan_secrets(docs: DataFrame, threshold: float = THRESHOLD, spans: str = "spans") -> DataFrame:
    """The rows of docs (doc_id, text) with an array of spans: kind, start, stop (code points, end exclusive), name, score.

    Kinds are assign, access, hex (the base; name and score null) and literal (of the method; only where no base span
    covers it). Spans stand by start, then kind in that order, then stop. Null and empty texts have none; repeated
    rows have theirs each; rows without an id keep them; an empty table gives no rows; other columns are left out.
    A text is read once by each pattern, so time is linear in its length.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            may = {k: pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_pylist() for k, pattern in MAY_HOLD.items()}
            read = pc.fill_null(pc.match_substring_regex(texts, MAY_ASSIGN), False).to_pylist()
            out = []
            for i in range(len(texts)):
                kinds = tuple(k for k in KINDS if may[k][i])
                if not kinds and not read[i]:
                    out.append([])
                    continue
                text = texts[i].as_py()
                base = base_spans(text, kinds)
                found = [(start, k, stop, None, None) for start, k, stop in base]
                if read[i]:
                    reach, covered = 0, []
                    for start, _, stop in base:  # how far base spans that start so early reach
                        reach = max(reach, stop)
                        covered.append((start, reach))
                    at = 0
                    for start, stop, name, score in scored(text, threshold):
                        while at < len(covered) and covered[at][0] <= start:
                            at += 1
                        if not at or covered[at - 1][1] < stop:
                            found.append((start, len(KINDS), stop, name, score))
                found.sort(key=lambda s: s[:3])
                out.append([{"kind": (*KINDS, "literal")[k], "start": a, "stop": b, "name": name, "score": score} for a, k, b, name, score in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", spans])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField(spans, SPAN)])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)


def op13_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts and digest of the base spans, and all spans; see scan_secrets()."""
    spans = F.col("found")
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    base = F.filter(spans, lambda x: x["kind"] != "literal")
    of = lambda k: F.filter(spans, lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return scan_secrets(documents(spark, sf_dir), spans="found").select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
