"""Hybrid retrieval: scope, hard filters, a rule lane and a vector lane, rank fusion, reranking, the best of each query."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking
from . import blocks, vectors

# Candidates of a lane, results, the constant and the weights of the fusion.
CANDIDATES, RESULTS, CONSTANT = 30, 5, 60
RULE_WEIGHT, VECTOR_WEIGHT = 10.0, 1.0
#: Queries that go to all tasks at once, and items that a task compares with them at once.
QUERY_BLOCK, ITEMS = 10_000, 64
DIGITS = 6


def in_scope(items: DataFrame, dimension: int, vector: str = "vector", **scope: str) -> DataFrame:
    """items of one scope (say dataset, model, template) whose vector has the dimension; a null in any of these is out.

    The equalities reach the scan, and its folders where the table is parted by them.
    """
    wanted = reduce(lambda a, b: a & b, (F.col(k) == v for k, v in scope.items()), F.lit(True))
    return items.where(wanted & (F.size(vector) == dimension))


def hard(item: str = "i", query: str = "q") -> Column:
    """Whether an item may be shown at all: each wanted diet, no excluded part, within the time; a query's nulls ask for nothing."""
    i, q = (lambda c: F.col(f"{item}.{c}")), (lambda c: F.col(f"{query}.{c}"))
    diets = F.size(F.array_except(q("diets"), i("diets"))) == 0
    apart = ~F.arrays_overlap(i("parts"), q("excluded"))
    return diets & F.coalesce(apart, F.lit(True)) & F.coalesce(i("minutes") <= q("limit"), q("limit").isNull())


def candidates(items: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """The rule lane and the vector lane: (query_id, item_id, score, rank) of the k best items of each query that pass hard().

    items: item_id, name, parts, scenarios, terms, diets (arrays), minutes, quality, vector. queries: query_id, text,
    parts, scenarios, terms, dish_terms, diets, excluded (arrays), max_minutes (scored), limit (hard), preference, vector.
    queries are a stated set: blocks of it go to all tasks and each block scans the items once, whole lists of items
    never meet; a task scores its items in matrices of items by queries and keeps its own k best of a query and lane
    before the shuffle. Rows that have nulls or other lengths of vectors are scored by columns. Ties go by item_id.
    """
    length = queries.agg(F.max(F.size("vector"))).first()[0]
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")
    whole = lambda *c: reduce(lambda x, y: x & y, (F.col(n).isNotNull() for n in c)) & (F.size("vector") == F.lit(length)) & F.coalesce(F.forall("vector", _number), F.lit(False))
    number = lambda c: F.col(c).isNull() | _number(F.col(c))
    fit_items = whole("item_id", "name", "parts", "scenarios", "terms", "diets", "vector") & F.coalesce(_number(F.col("minutes")) & _number(F.col("quality")), F.lit(False))
    fit_queries = whole("query_id", "text", "parts", "scenarios", "terms", "dish_terms", "diets", "excluded", "vector") & number("max_minutes") & number("limit") & number("preference")
    fit_items, fit_queries = F.coalesce(fit_items, F.lit(False)), F.coalesce(fit_queries, F.lit(False))
    double = lambda *c: (F.col(n).cast("double").alias(n) for n in c)
    vector = F.col("vector").cast("array<double>").alias("vector")
    rows = items.where(fit_items).select("item_id", F.lower("name").alias("lower"), plain("name").alias("plain"), "parts", "scenarios", "terms", "diets", *double("minutes", "quality"), vector)
    asked = queries.where(fit_queries).select("query_id", plain("text").alias("said"), "parts", "scenarios", "terms", "dish_terms", "diets", "excluded", *double("max_minutes", "limit", "preference"), vector)
    schema = f"lane string, query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, score double"
    spark = items.sparkSession
    number_of_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = []
    for b in range(number_of_blocks):
        block = asked if number_of_blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(number_of_blocks)) == b)
        sent = spark.sparkContext.broadcast(block.toArrow())
        found.append(rows.mapInArrow(partial(_task_lanes, sent, k), schema))
    best = reduce(DataFrame.unionByName, found)
    odd = _met(items.where(~fit_items), queries).unionByName(_met(items.where(fit_items), queries.where(~fit_queries)))
    by_lane = F.explode(F.array(*(F.struct(F.lit(n).alias("lane"), F.col(n).alias("score")) for n in ("rule", "cosine")))).alias("s")
    scored = best.unionByName(odd.select("query_id", "item_id", by_lane).select("s.lane", "query_id", "item_id", "s.score"))
    ranked = vectors.top_k(scored.withColumn("_of", F.struct("lane", "query_id")), "_of", "item_id", "score", k).drop("_of").checkpoint()  # both lanes in one pass
    return tuple(ranked.where(F.col("lane") == n).drop("lane") for n in ("rule", "cosine"))


def _number(c: Column) -> Column:
    """Whether c is a finite number."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


class _Sets:
    """The sets of all queries in one column, to count what each item's set has in common with each of them."""

    def __init__(self, sets: list[list], nulls: bool = True):
        self.number: dict = {}
        kept = [{x for x in s if nulls or x is not None} for s in sets]
        for s in kept:
            for x in s:
                self.number.setdefault(x, len(self.number))
        self.sizes = np.array([len(s) for s in kept])
        self.holds = np.zeros((len(self.number) + 1, len(sets)), np.int16)  # the last row: values that no query has
        for q, s in enumerate(kept):
            self.holds[[self.number[x] for x in s], q] = 1

    def common(self, sets: list[list]) -> np.ndarray:
        """By item and query: how many values are in both sets."""
        at, starts = [], []
        for s in sets:
            starts.append(len(at))
            at += {self.number.get(x, -1) for x in s} - {-1} or {len(self.number)}
        return np.add.reduceat(self.holds[at], starts, axis=0)


class _Found(NamedTuple):
    """Queries and items by number, and scores."""

    query: np.ndarray
    item: np.ndarray
    score: np.ndarray


class _Queries:
    """Queries as matrices, and the best items that a task has seen of each, by lane."""

    def __init__(self, table: pa.Table, k: int):
        c = table.to_pydict()
        self.k, self.n = k, table.num_rows
        self.parts, self.scenarios, self.terms, self.diets = (_Sets(c[n]) for n in ("parts", "scenarios", "terms", "diets"))
        self.excluded = _Sets(c["excluded"], nulls=False)
        self.n_parts, self.n_terms = (np.array([len(x) for x in c[n]], float) for n in ("parts", "terms"))
        self.said = "\n".join(c["said"])
        self.starts = np.cumsum([0] + [len(x) + 1 for x in c["said"]])[:-1].tolist()
        self.dishes: dict[str, list[int]] = {}
        for q, words in enumerate(c["dish_terms"]):
            for w in words:
                if w is not None:
                    self.dishes.setdefault(w, []).append(q)
        number = lambda n: np.array([np.nan if x is None else x for x in c[n]], float)
        self.max_minutes, self.limit, preference = number("max_minutes"), number("limit"), number("preference")
        self.timed = np.flatnonzero(~np.isnan(self.max_minutes))
        self.preference = np.where(np.isnan(preference), 0.0, preference * 3.0)
        self.vectors = blocks._Lane(np.array(c["vector"], float).reshape(self.n, -1), (0, None))
        none = _Found(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.best = {"rule": none, "cosine": none}
        self.waiting = {lane: [none] for lane in self.best}  # the best so far and what may be better
        self.least = {lane: np.full(self.n, -np.inf) for lane in self.best}
        self.seen: list = []  # ids of the items that are kept, by number

    def rule(self, c: dict[str, list], minutes: np.ndarray) -> np.ndarray:
        """The rule score of items by queries, not rounded; parts are added in the order of ranking.rule_score."""
        with np.errstate(all="ignore"):
            coverage = np.where(self.n_parts > 0, self.parts.common(c["parts"]) / self.n_parts, 0.0)
            score = coverage * 8.0
            score += np.where((self.n_parts > 0) & (coverage == 1.0), 3.0, 0.0)
            for i, name in enumerate(c["plain"]):
                at = self.said.find(name) if name else -1
                held = set()
                while at >= 0:
                    held.add(bisect(self.starts, at) - 1)
                    at = self.said.find(name, at + 1)
                score[i, list(held)] += 5.0
            dishes = np.zeros(score.shape)
            names = pa.array(c["lower"], pa.string())
            for word, asking in self.dishes.items():
                rows = np.flatnonzero(pc.match_substring(names, word).to_numpy(zero_copy_only=False))
                for q in asking if len(rows) else ():
                    dishes[rows, q] += 2.0
            score += dishes
            score += self.scenarios.common(c["scenarios"]) * 3.0
            spare = self.max_minutes[self.timed] - minutes[:, None]
            score[:, self.timed] += np.where(spare >= 0, 3.0 + spare / 30, -np.minimum(3.0, -spare / 10))
            score += self.preference
            score += np.where(self.n_terms > 0, self.terms.common(c["terms"]) / self.n_terms, 0.0)
            return score + (np.array(c["quality"], float) * 0.01)[:, None]

    def compare(self, rows: pa.RecordBatch) -> None:
        c = rows.drop_columns(["vector"]).to_pydict()
        minutes = np.array(c["minutes"], float)
        shown = self.diets.common(c["diets"]) == self.diets.sizes
        shown &= self.excluded.common(c["parts"]) == 0
        shown &= ~(minutes[:, None] > self.limit)
        items = blocks._Lane(rows.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(minutes), -1), (0, None))
        first = len(self.seen)
        self.seen += c["item_id"]
        self.keep("rule", np.where(shown, self.rule(c, minutes), -np.inf), first, None)
        self.keep("cosine", np.where(shown, items.unit @ self.vectors.unit.T, -np.inf), first, items)
        if max(sum(len(f.query) for f in w[1:]) for w in self.waiting.values()) >= self.k * self.n:
            self.merge()

    def keep(self, lane: str, about: np.ndarray, first: int, items: blocks._Lane | None) -> None:
        rows, queries = np.nonzero((about >= self.least[lane] - 10.0**-DIGITS) & (about > -np.inf))
        if len(rows):
            score = blocks.rounded(about[rows, queries], DIGITS) if items is None else items.scores(rows, self.vectors, queries)
            self.waiting[lane].append(_Found(queries, rows + first, score))

    def merge(self) -> None:
        """Put what waits to the best, and forget the items that are no longer among them."""
        ids = np.array(self.seen)
        for lane, waiting in self.waiting.items():
            q, i, s = (np.concatenate(x) for x in zip(*waiting))
            order = np.lexsort((ids[i], -s, q))
            q, i, s = q[order], i[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            last = rank == self.k - 1
            self.least[lane][q[last]] = s[last]
            self.best[lane] = _Found(q[rank < self.k], i[rank < self.k], s[rank < self.k])
        used = np.unique(np.concatenate([b.item for b in self.best.values()]))
        self.seen = [self.seen[i] for i in used]
        self.best = {lane: _Found(b.query, np.searchsorted(used, b.item), b.score) for lane, b in self.best.items()}
        self.waiting = {lane: [b] for lane, b in self.best.items()}


def _task_lanes(sent: Broadcast, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, kind = sent.value, None
    queries = _Queries(table, k) if table.num_rows else None
    for batch in batches:
        kind = batch.schema.field("item_id").type
        for start in range(0, batch.num_rows if queries else 0, ITEMS):
            queries.compare(batch.slice(start, ITEMS))
    if queries:
        queries.merge()
        for lane, found in queries.best.items():
            if len(found.query):
                ids = pa.array([queries.seen[x] for x in found.item], kind)
                yield pa.RecordBatch.from_arrays([pa.array([lane] * len(ids)), table.column("query_id").combine_chunks().take(pa.array(found.query)), ids, pa.array(found.score)], names=["lane", "query_id", "item_id", "score"])


def _met(items: DataFrame, queries: DataFrame) -> DataFrame:
    pairs = items.alias("i").join(F.broadcast(queries).alias("q"), hard())
    c = {
        "item_parts": F.col("i.parts"), "query_parts": F.col("q.parts"), "item_scenarios": F.col("i.scenarios"), "query_scenarios": F.col("q.scenarios"),
        "item_terms": F.col("i.terms"), "query_terms": F.col("q.terms"), "dish_terms": F.col("q.dish_terms"), "item_name": F.col("i.name"), "query_text": F.col("q.text"),
        "minutes": F.col("i.minutes"), "max_minutes": F.col("q.max_minutes"), "preference": F.col("q.preference"), "quality": F.col("i.quality"),
    }
    return pairs.select("query_id", "item_id", ranking.rule_score(c).alias("rule"), F.round(vectors.cosine(F.col("i.vector"), F.col("q.vector")), 6).alias("cosine"))


def retrieve(items: DataFrame, queries: DataFrame, k: int = CANDIDATES, first: int = RESULTS, weights: tuple[float, float] = (RULE_WEIGHT, VECTOR_WEIGHT)) -> DataFrame:
    """(query_id, item_id, rank, score, fused, coverage, in_rule, in_vector): the best items of each query by both lanes.

    Fused candidates are few (two lanes of k a query); they alone meet their items again, for the parts that the final
    score adds to the fused one. A query without any item that passes gives no rows.
    """
    rule, vector = candidates(items, queries, k)
    lanes = rule.select("query_id", "item_id", "rank", F.lit("rule").alias("lane")).unionByName(vector.select("query_id", "item_id", "rank", F.lit("vector").alias("lane")))
    fused = vectors.fuse([(lanes.where("lane = 'rule'"), weights[0]), (lanes.where("lane = 'vector'"), weights[1])], CONSTANT)
    came = lanes.groupBy("query_id", "item_id").agg(F.bool_or(F.col("lane") == "rule").alias("in_rule"), F.bool_or(F.col("lane") == "vector").alias("in_vector"))
    pairs = fused.withColumnRenamed("score", "fused").join(came, ["query_id", "item_id"])
    pairs = pairs.join(items.select("item_id", F.struct("parts", "scenarios", "quality").alias("i")), "item_id").join(queries.select("query_id", F.struct("parts", "scenarios").alias("q")), "query_id")
    coverage = ranking.share(F.col("i.parts"), F.col("q.parts"))
    score = ranking.rerank_score(F.col("fused"), coverage, F.size(F.array_intersect("i.scenarios", "q.scenarios")), F.col("i.quality"))
    scored = pairs.select("query_id", "item_id", F.round(score, 6).alias("score"), "fused", F.round(coverage, 4).alias("coverage"), "in_rule", "in_vector")
    return vectors.top_k(scored, "query_id", "item_id", "score", first)
