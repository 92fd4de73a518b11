"""Every registered query of the engine that has SQL agrees with DuckDB on the smallest data."""

import math
import os

import duckdb
import pytest

from excerpta.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "lineitem", "customer")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(str(plain(r[c])) for c in columns) for r in df.collect()])
    sql = catalog.oracle_sql().get(name)
    assert sql, "every query of the engine has SQL"
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(str(plain(r[i])) for i in at) for r in rel.fetchall())
