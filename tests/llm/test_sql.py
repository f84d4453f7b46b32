"""Queries with SQL, against DuckDB."""

import pytest

from crategraph.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, medium, name):
    assert_same(QUERIES[name](spark, medium), ORACLE_SQL[name], medium)
