"""Every named query runs and equals its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, rows_of

FOLDER = entry.ENTRY_TABLES
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["full_name", "clone_num", "tr_start", "tr_end", "value", "version"] and out.count() == 1200


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    assert got
    if name in ORACLES:
        cursor = db.execute(ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, cursor.fetchall())
