"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import decimal
import math
import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.oracle_sql() if k[:2] != "op"))
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect()) == want
