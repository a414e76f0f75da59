"""Every registered query with SQL against DuckDB, over whole tables of the smallest size."""

import glob
import os

import duckdb
import pytest

from veilmark.plans import extended, own_columns, planning, registry

QUERIES, SQL = registry.queries() | planning.queries() | extended.queries() | own_columns.queries(), registry.oracle_sql() | planning.oracle_sql() | extended.oracle_sql() | own_columns.oracle_sql()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def _rows(rows):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    other = tables.sql(SQL[name])
    assert sorted(other.columns) == columns
    wanted = tables.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert _rows(map(tuple, df.select(*columns).collect())) == _rows(wanted)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
