"""Every query with an SQL twin gives its rows, on the smallest tables; the others give rows with a stable schema."""

import pytest

from terrasheet.plans import catalogue

from .oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, name):
    assert difference(spark, SF, catalogue.queries()[name], catalogue.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_gives_rows(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert df.columns == catalogue.queries()[name](spark, SF).columns
    assert df.count() > 0
