"""The physical plans that matter at scale."""

import re

import pytest
from frames import bars, events

from eventide.operators.clean import clean_bars
from eventide.operators.metrics import event_summary
from eventide.operators.sessions import bar_trades, sessionize
from eventide.operators.windows import event_day_metrics
from eventide.plans import catalog, serve
from eventide.schemas import BARS, EVENT_DAY_METRICS, RAW_BARS
from eventide.sources import tables
from eventide.sources.layers import read_layer, write_layer


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def tree(df) -> str:
    return plan(df).split("\n\n")[0]


def scans(df) -> int:
    return len(re.findall(r"Scan parquet", tree(df)))


@pytest.fixture(scope="module")
def stored_bars(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars"))
    write_layer(bars(spark, ("A", "2024-06-10", 1, 1), ("B", "2024-06-10", 1, 1)), path, "ticker")
    return path


@pytest.fixture(scope="module")
def stored_days(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("days"))
    days = event_day_metrics(events(spark, ("A", "2024-06-10"), ("B", "2024-06-10")),
                             bars(spark, ("A", "2024-06-10", 1, 1)))
    write_layer(days, path, "ticker")
    return path


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_python_in_any_query(spark, sf_dir, name):
    text = tree(catalog.queries()[name](spark, sf_dir))
    assert not re.search(r"EvalPython|InPandas|InArrow|CartesianProduct|NestedLoop", text), name


def test_one_scan_for_bar_trades(spark, stored_bars):
    assert scans(bar_trades(read_layer(spark, stored_bars, BARS))) == 1


def test_one_scan_and_one_shuffle_for_summaries(spark, stored_days):
    df = event_summary(read_layer(spark, stored_days, EVENT_DAY_METRICS))
    assert scans(df) == 1 and tree(df).count("Exchange") == 1


def test_summary_of_fresh_windows_shuffles_once_after_the_join(spark, stored_bars):
    days = event_day_metrics(events(spark, ("A", "2024-06-10")), read_layer(spark, stored_bars, BARS))
    text = tree(event_summary(days))
    assert text[:text.index("Join")].count("Exchange") == 1


def test_ticker_filter_reaches_the_partitions(spark, stored_days, stored_bars):
    days = read_layer(spark, stored_days, EVENT_DAY_METRICS)
    for df in (serve.ticker_window(days, "a"), serve.ticker_events(event_summary(days), "a")):
        assert "PartitionFilters: [isnotnull(ticker" in plan(df)
    fresh = event_day_metrics(events(spark, ("A", "2024-06-10")), read_layer(spark, stored_bars, BARS))
    filters = re.findall(r"PartitionFilters: \[[^\n]*", plan(fresh.filter("ticker = 'A'")))
    assert filters and all("= A" in f for f in filters)


def test_on_demand_lookup_of_one_ticker_prunes_every_stored_table(spark, stored_days, stored_bars):
    from datetime import datetime
    stamps = spark.createDataFrame([("A", datetime(2024, 6, 10))], "ticker string, event_ts timestamp")
    df = serve.window_or_on_demand(
        read_layer(spark, stored_days, EVENT_DAY_METRICS), stamps,
        read_layer(spark, stored_bars, BARS), datetime(2024, 12, 31), ticker="a")
    filters = re.findall(r"PartitionFilters: \[[^\n]*", plan(df))
    assert len(filters) == scans(df) == 3 and all("= A" in f for f in filters)


def test_window_rows_read_only_served_columns(spark, stored_days):
    text = plan(serve.ticker_window(read_layer(spark, stored_days, EVENT_DAY_METRICS), "a"))
    schema = re.search(r"ReadSchema: struct<([^\n]*)>", text).group(1)
    assert "open" not in schema and "fiscal_quarter" not in schema and "close" in schema


def test_cleaning_filters_reach_the_scan_and_combine_before_the_shuffle(spark, tmp_path):
    from frames import raw_bars
    path = str(tmp_path / "raw")
    raw_bars(spark, ("A", "2024-06-10", 1.0, 1.0, 1.0, 1.0, 1)).write.parquet(path)
    df = clean_bars(read_layer(spark, path, RAW_BARS))
    pushed = re.search(r"PushedFilters: \[[^\n]*", plan(df)).group(0)
    assert "GreaterThan(volume,0)" in pushed and "IsNotNull(close)" in pushed
    text = tree(df)
    assert text.count("Exchange") == 1 and text.count("SortAggregate") == 2


def test_newest_events_are_limited_before_the_shuffle(spark, stored_days):
    summary = event_summary(read_layer(spark, stored_days, EVENT_DAY_METRICS))
    text = tree(serve.ticker_events(summary, limit=50))
    assert text.count("WindowGroupLimit") == 2


def test_nothing_of_trades_is_broadcast_by_hint(spark, sf_dir):
    plan = sessionize(tables.trades(spark, sf_dir), tie_break=["trade_id"])
    assert "ResolvedHint" not in plan._jdf.queryExecution().analyzed().toString()
    assert "hint" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_no_sort_below_a_curve(spark, stored_days, stored_bars):
    from datetime import datetime
    stamps = spark.createDataFrame([("A", datetime(2024, 6, 10))], "ticker string, event_ts timestamp")
    days, bar_rows = read_layer(spark, stored_days, EVENT_DAY_METRICS), read_layer(spark, stored_bars, BARS)
    for rows in (serve.window_rows(days, "A"), serve.windows_of_ticker(
            days, event_summary(days), stamps, bar_rows, datetime(2024, 12, 31), ticker="A", in_order=False)):
        for curve in (serve.return_curve(rows), serve.volume_curve(rows)):
            logical = curve._jdf.queryExecution().optimizedPlan().toString()
            assert logical.count("Sort [") == 1 and logical.lstrip().startswith("Sort [")
