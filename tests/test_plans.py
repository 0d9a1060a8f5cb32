"""Every plan that has SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Plans that may find nothing in the smallest tables.
EMPTY = {"ngram_jaccard_pairs", "self_join_inequality"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_plan(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.sql(catalogue.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    at = [found.columns.index(c) for c in names]
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert ours == theirs and (ours or name in EMPTY)
