"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shown(value):
    if value is None or value != value:
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(table):
    return sorted(tuple(shown(r[c]) for c in sorted(r)) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, tables, name):
    got = entry.queries()[name](spark, DATA).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.num_columns and (got.num_rows or name.startswith("op"))
        return
    want = tables.sql(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
