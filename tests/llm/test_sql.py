"""The registered queries against their SQL, over whole tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_point
from eventide.llm import queries, sql


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_all_and_the_pipeline_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.queries())
    assert numbers == list(range(1, 14))
    assert set(queries.queries()) | {"pipeline"} <= set(entry_point.queries())
    assert set(sql.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_rows(spark, con, sf_dir, name):
    query = queries.queries()[name]
    rows, only_spark, only_sql = differences(spark, con, query, sql.oracle_sql()[name], sf_dir)
    assert rows and not only_spark and not only_sql, (list(only_spark)[:2], list(only_sql)[:2])


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op3_url_filters", "op6_exact_dedup", "op7_quality_rules"])
def test_native_queries_run_no_python(spark, sf_dir, name):
    plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
