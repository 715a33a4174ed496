"""Every catalogue query with a SQL twin returns the same rows in Spark and DuckDB."""

import pytest

from loanforge.plans.catalog import all_queries, all_sql
from oracle import compare, connect

QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = connect(sf)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, con, name):
    assert compare(spark, con, sf, name, QUERIES[name], SQL[name]) == ""


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
