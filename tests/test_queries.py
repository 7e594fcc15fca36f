"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import SMALL, entry, oracle_sql, queries
from check import comparable

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in sorted(os.listdir(SMALL)):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def test_entry(spark):
    assert entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sql, name):
    df = queries()[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLES:
        cursor = sql.execute(ORACLES[name])
        want = comparable([d[0] for d in cursor.description], cursor.fetchall())
        assert comparable(df.columns, rows) == want
