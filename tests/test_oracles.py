"""Every query against its SQL over the same tables."""

import datetime as dt
import math
from decimal import Decimal

import duckdb
import pytest

from tablewright import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows(columns, cursor.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
