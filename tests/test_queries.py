"""Every query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(str(plain(r[c])) for c in columns) for r in df.collect())
    assert got
    if name not in catalog.ORACLE_SQL:
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(str(plain(row[i])) for i in at) for row in found.fetchall())


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) <= set(entry.queries())
