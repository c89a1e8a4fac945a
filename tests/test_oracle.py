"""Every registered query against its SQL twin, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from workload import load
from tests.conftest import SF
from tools.check import TABLES, rows_of

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    res = con.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(res.fetchall(), names)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["scenario", "tech", "year", "y"]
    assert df.count() > 0
