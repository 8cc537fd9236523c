"""Every registered query of the grid against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

GRID = {n: q for m in entry.PLANS for n, q in m.QUERIES.items()}
SQL = {n: q for m in entry.PLANS for n, q in m.ORACLE_SQL.items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(values):
    return sorted((tuple(repr(v) for v in r) for r in values))


@pytest.mark.parametrize("name", sorted(GRID))
def test_query(spark, sf_dir, duck, name):
    found = GRID[name](spark, sf_dir)
    columns = sorted(found.columns)
    mine = rows(found.select(*columns).collect())
    if name not in SQL:
        assert mine
        return
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == columns
    assert mine == rows(expected.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_and_table_agree(spark, sf_dir):
    table = {(r["start"], r["path"]): r["n"] for r in GRID["g1_event_density"](spark, sf_dir).collect()}
    stream = {(r["start"], r["path"]): r["n"] for r in GRID["g1_event_density_stream"](spark, sf_dir).collect()}
    assert stream and stream == table
