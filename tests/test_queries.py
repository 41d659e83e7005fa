"""Every query against its SQL on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from quadloom import queries as graph

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{float(v):.9g}")
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", [n for n in graph.queries() if n in graph.oracle_sql()])
def test_query(spark, duck, name):
    df = graph.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    res = duck.execute(graph.oracle_sql()[name])
    names = [d[0] for d in res.description]
    theirs = sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in res.fetchall())
    assert sorted(names) == cols
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
