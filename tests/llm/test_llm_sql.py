"""Text queries with SQL against DuckDB, those without for rows."""

import pytest

import compare
from loomgraph.llm import queries
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    ok, what = compare.compare(spark, duck, name, SMALL)
    assert ok, what


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
