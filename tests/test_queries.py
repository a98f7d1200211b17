"""The driver contract: entry() runs; every SQL-checked query equals its
DuckDB oracle on the sf0.001 tables (same digest as tools/check_oracle.py)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from regcast.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_entry_returns_predictions(spark):
    df = E.entry(spark)
    assert df.columns == ["idx", "Real", "Prediction"]
    assert df.count() > 0


def test_every_query_has_a_callable_and_sql_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    from tools.check_oracle import digest

    got = digest(E.queries()[name](spark, SF).toPandas())
    exp = digest(con.execute(E.oracle_sql()[name]).df())
    assert got == exp
