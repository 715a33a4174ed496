"""Corpus queries with a SQL twin return its rows."""

import pytest
from oracle import compare, connect

from loanforge.llm.queries import REG


@pytest.mark.parametrize("name", sorted(REG.sql))
def test_same_rows(spark, sf, name):
    con = connect(sf)
    assert compare(spark, con, sf, name, REG.queries[name], REG.sql[name]) == ""
