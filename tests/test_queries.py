"""Every registered query of the core against its SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry_point

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")
CORE = sorted(n for m in entry_point.MODULES if ".llm." not in m.__name__ for n in m.QUERIES)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() >= 0
