"""Every query with SQL gives the rows that the SQL gives."""

import math

import duckdb
import pytest

import __spark_entry__
from rillgraph.plans import catalogue

def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for t in ("review_example", "review_case", "corpus_graph", "benchmark_query", "query_cache", "embeddings"):
        c.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_same_rows(spark, duck, tables, name):
    df = catalogue.QUERIES[name](spark, tables)
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(x) for x in r) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.SQL])
def test_runs(spark, tables, name):
    assert catalogue.QUERIES[name](spark, tables).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
