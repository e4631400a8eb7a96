"""Every query with SQL gives the same rows at the smallest scale."""

import pytest

import __spark_entry__ as e
from tests.compare import compare

SQL = e.oracle_sql()


def test_entry_runs(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, name):
    assert compare(spark, e.queries()[name], SQL[name], small) == ""
