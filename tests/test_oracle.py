"""Every query of the core with SQL against DuckDB on the smallest tables."""

import pytest

import compare
from loomgraph.plans import catalogue
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, name):
    ok, what = compare.compare(spark, duck, name, SMALL)
    assert ok, what


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0
