"""Every query with SQL against DuckDB over the same tables."""

import glob
import os

import duckdb
import pytest
from tessera.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(table, names):
    show = lambda x: repr(round(x, 6)) if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[c]) for c in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toArrow()
    want = duck.sql(SQL[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert sorted(got.column_names) == sorted(want.column_names)
    names = sorted(got.column_names)
    assert rows(got, names) == rows(want, names)


def test_all_queries_are_registered():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
