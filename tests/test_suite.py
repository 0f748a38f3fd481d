import pytest

from oracle import assert_same
from skein import suite


@pytest.mark.parametrize("name", sorted(suite.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    assert_same(spark, small, suite.QUERIES[name], suite.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(suite.QUERIES) - set(suite.ORACLE_SQL)))
def test_query_runs(spark, small, name):
    assert suite.QUERIES[name](spark, small).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
