"""Queries with an SQL twin give its rows, on the smallest tables."""

import pytest

from terrasheet.llm import queries

from ..oracle import difference


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    assert difference(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""
