"""Every catalog query runs; those with SQL give DuckDB's rows."""

import pytest

import __spark_entry__
from crategraph.plans import ORACLE_SQL, QUERIES
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in ORACLE_SQL:
        assert_same(df, ORACLE_SQL[name], small)
    else:
        assert df.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
