"""The driver contract: queries run, and equal their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
LIBRARY = [q for q in contract.queries() if not q.startswith("op") and q != "pipeline"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows_of(rows):
    return sorted(repr(tuple(r)) for r in rows)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", LIBRARY)
def test_query(spark, tables, name):
    df = contract.queries()[name](spark, SF)
    got = df.collect()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    columns = sorted(df.columns)
    want = tables.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert rows_of([[r[c] for c in columns] for r in got]) == rows_of(want)
