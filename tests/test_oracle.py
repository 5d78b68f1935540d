"""Registered queries beside their SQL on the smallest tables: every seventh, or all with BARLOOM_ALL=1."""

import math
import os

import duckdb
import pytest

from barloom.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def near(a, b):
    return a == b or isinstance(a, float | int) and isinstance(b, float | int) and abs(a - b) <= 2e-6 * max(1, abs(a))


CHOSEN = sorted(QUERIES)[:: 1 if os.environ.get("BARLOOM_ALL") else 7]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    cur = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall()), key=str)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if not all(near(x, y) for x, y in zip(a, b, strict=True))]
    assert not bad, bad[:3]
