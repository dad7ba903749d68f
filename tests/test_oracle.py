"""Every registered query against its SQL, over the whole tables."""

import pytest

import __spark_entry__ as entry_point
import oracle_queries
from eventide.plans import catalog
from compare import connect, differences

QUERIES = catalog.queries()
SQL = oracle_queries.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, sf_dir, name):
    rows, only_spark, only_sql = differences(spark, con, QUERIES[name], SQL[name], sf_dir)
    assert not only_spark and not only_sql, (name, list(only_spark)[:2], list(only_sql)[:2])


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
