"""Every query that has SQL against DuckDB, on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def plain(rows):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in ([tuple(map(str, r)) for r in rows]))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.select(*columns).collect()) == plain(rows)
    assert rows or name == "compact_plan"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
