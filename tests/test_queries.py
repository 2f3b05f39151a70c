"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from sparkloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in registry.oracles():
        assert got
        return
    want = duck.sql(registry.oracles()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(str(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert all(TYPES.get(k, kinds[c]) == kinds[c] for c, k in df.dtypes)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "doc_id", "group_key", "total", "rank"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
