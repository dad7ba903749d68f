"""All stages over the table adapters, and the lookups over what they wrote."""

import shutil
import time
from datetime import datetime

import pytest
from frames import dicts, raw_bars
from pyspark.sql import functions as F

from eventide.operators.clean import clean_bars
from eventide.operators.metrics import cohort_metrics, event_summary
from eventide.operators.windows import event_day_metrics
from eventide.plans import serve
from eventide.plans.pipeline import Pipeline
from eventide.sources import tables
from eventide.sources.layers import read_layer
from eventide.schemas import EVENT_DAY_METRICS, LANDED_ANNOUNCEMENTS, LANDED_BARS, TRADE_SESSIONS
from eventide.sources.landed import read_bars
from eventide.sources.snapshots import current

STUDY = tables.TABLE_STUDY
TICKERS = [f"NATION_{i}" for i in range(25)]


@pytest.fixture(scope="module")
def run(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run"))
    pipeline = Pipeline(spark, root, STUDY)
    inputs = (tables.vendor_bars(spark, sf_dir), tables.vendor_announcements(spark, sf_dir))
    counts = pipeline.run(*inputs, datetime(2024, 1, 1), TICKERS)
    return pipeline, inputs, counts


def test_counts_match_the_tables(spark, run):
    pipeline, _, counts = run
    assert counts["silver"]["prices"] == pipeline.silver_bars().count() > 0
    assert counts["silver"]["announcements"] == pipeline.silver_announcements().count()
    days = read_layer(spark, f"{pipeline.gold}/event_day_metrics", EVENT_DAY_METRICS)
    assert counts["event_days"]["event_day_metrics"] == days.count()
    sessions = read_layer(spark, f"{pipeline.gold}/trade_sessions", TRADE_SESSIONS)
    assert counts["sessions"]["trade_sessions"] == sessions.count() == 4 * counts["silver"]["prices"]
    # Bar trades lie at least 90 minutes apart.
    assert counts["sessions"]["distinct_sessions"] == counts["sessions"]["trade_sessions"]
    gold = serve.GoldTables(spark, pipeline.gold)
    assert counts["cohorts"]["event_summary"] == gold.event_summary().count()
    assert counts["cohorts"]["daily_cohort_metrics"] == gold.cohorts().count() == 33
    (line,) = spark.read.json(f"{pipeline.bronze}/_manifest").collect()
    assert line["row_counts"].asDict() == counts["bronze"] and len(line["tickers"]) == 25


def test_gold_equals_the_study_in_memory(spark, run):
    pipeline, _, _ = run
    days = event_day_metrics(pipeline.silver_announcements(), pipeline.silver_bars(), STUDY)
    gold = serve.GoldTables(spark, pipeline.gold)
    for stored, fresh in ((gold.event_day_metrics(), days),
                          (gold.event_summary(), event_summary(days)),
                          (gold.cohorts(), cohort_metrics(days))):
        fresh = fresh.select(*stored.columns)
        assert stored.exceptAll(fresh).isEmpty() and fresh.exceptAll(stored).isEmpty()


def test_second_run_gives_the_same_tables(spark, run, tmp_path):
    first, inputs, counts = run
    second = Pipeline(spark, str(tmp_path), STUDY)
    assert second.run(*[x.repartition(13) for x in inputs], datetime(2024, 1, 2), TICKERS) == counts
    for name in ("event_day_metrics", "event_summary", "daily_cohort_metrics", "trade_sessions"):
        a, b = (spark.read.parquet(*current(spark, f"{p.gold}/{name}").paths(f"{p.gold}/{name}"))
                for p in (first, second))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_subset_run_can_leave_other_tickers_alone(spark, run, tmp_path):
    _, inputs, _ = run
    Pipeline(spark, str(tmp_path), STUDY).load_bronze(*inputs, datetime(2024, 1, 1), TICKERS[:3])
    one = spark.createDataFrame([("NATION_1",)], "ticker string")
    Pipeline(spark, str(tmp_path), STUDY, replace="touched").load_bronze(
        *inputs, datetime(2024, 1, 2), one)
    left = read_layer(spark, f"{tmp_path}/bronze/announcements", LANDED_ANNOUNCEMENTS).select("ticker").distinct()
    assert sorted(r[0] for r in left.collect()) == TICKERS[:3]
    Pipeline(spark, str(tmp_path), STUDY).load_bronze(*inputs, datetime(2024, 1, 3), one)
    left = read_layer(spark, f"{tmp_path}/bronze/announcements", LANDED_ANNOUNCEMENTS).select("ticker").distinct()
    assert [r[0] for r in left.collect()] == ["NATION_1"]


def test_bronze_range_excludes_the_end_for_prices_only(spark, run):
    pipeline, inputs, counts = run
    prices = read_layer(spark, f"{pipeline.bronze}/prices", LANDED_BARS)
    assert prices.filter(F.col("trade_date") >= STUDY.end.isoformat()).isEmpty()
    wanted = inputs[1].filter(F.col("event_date").between(str(STUDY.start), str(STUDY.end)))
    assert counts["bronze"]["announcements"] == wanted.count()


def test_null_reports(run):
    pipeline, _, counts = run
    rows = {(r["table_name"], r["column_name"]): r for r in pipeline.null_reports().collect()}
    assert len(rows) == 9 + 5 and all(r["null_count"] == 0 for r in rows.values())
    assert rows["silver/prices", "close"]["total_rows"] == counts["silver"]["prices"]


def test_ticker_list_and_chips(spark, run):
    gold = serve.GoldTables(spark, run[0].gold)
    rows = dicts(serve.ticker_list(gold.event_summary()))
    assert [r["ticker"] for r in rows] == sorted(TICKERS)
    assert sum(r["event_count"] for r in rows) == gold.event_summary().count()
    assert [r["ticker"] for r in serve.ticker_chips(gold.event_summary()).collect()] == sorted(TICKERS)[:12]


def test_newest_events(spark, run):
    summary = serve.GoldTables(spark, run[0].gold).event_summary()
    rows = [r.asDict() for r in serve.ticker_events(summary, " nation_3 ", limit=4).collect()]
    dates = [r["event_date"] for r in rows]
    assert len(rows) == 4 and dates == sorted(dates, reverse=True)
    newest = summary.filter("ticker = 'NATION_3'").agg(F.max("event_date")).first()[0]
    assert dates[0] == newest.isoformat()
    assert {r["event_count"] for r in rows} == {4}
    assert {r["ticker_cap_bucket"] for r in rows} == {"LARGE"}
    every = serve.ticker_events(summary, limit=4)
    assert every.count() == 100
    assert every.filter("ticker = 'NATION_3'").exceptAll(
        serve.ticker_events(summary, "NATION_3", limit=4)).isEmpty()


@pytest.mark.parametrize("limit", [0, -1])
def test_limit_is_checked(spark, run, limit):
    with pytest.raises(ValueError):
        serve.ticker_events(serve.GoldTables(spark, run[0].gold).event_summary(), "A", limit)


def test_unknown_names_give_nothing(spark, run, tmp_path):
    gold = serve.GoldTables(spark, run[0].gold)
    assert serve.ticker_events(gold.event_summary(), "nobody").isEmpty()
    assert serve.ticker_window(gold.event_day_metrics(), "NATION_1", "no_event").isEmpty()
    empty = serve.GoldTables(spark, str(tmp_path))
    assert serve.ticker_list(empty.event_summary()).isEmpty()
    assert serve.cohort_rows(empty.cohorts()).isEmpty()


def test_window_and_curves(spark, run):
    days = serve.GoldTables(spark, run[0].gold).event_day_metrics()
    window = serve.ticker_window(days, "NATION_2")
    rows = [r.asDict() for r in window.collect()]
    keys = [(r["event_id"], r["relative_day"]) for r in rows]
    assert keys == sorted(keys) and all(len(r["event_date"]) == 10 for r in rows)
    one = serve.ticker_window(days, "NATION_2", keys[0][0])
    assert one.count() == sum(k[0] == keys[0][0] for k in keys)
    curve = {r["day"]: r["avg_return"] for r in serve.return_curve(window).collect()}
    for day, value in curve.items():
        seen = [r["cum_return"] for r in rows if r["relative_day"] == day and r["cum_return"] is not None]
        assert value is None if not seen else abs(value - sum(seen) / len(seen) * 100) < 6e-4
    assert curve[-5] is None
    volumes = serve.volume_curve(window).collect()
    assert [r["day"] for r in volumes] == list(range(-5, 6))
    assert serve.window_event_count(window).first()[0] == len({k[0] for k in keys})


def test_cohort_lookup(spark, run):
    cohorts = serve.GoldTables(spark, run[0].gold).cohorts()
    rows = [r.asDict() for r in serve.cohort_rows(cohorts).collect()]
    assert [(r["relative_day"], r["cap_bucket"]) for r in rows] == [
        (x, c) for x in range(-5, 6) for c in ("LARGE", "MID", "SMALL")]
    assert {r["cap_bucket"] for r in serve.cohort_rows(cohorts, "small").collect()} == {"SMALL"}


def test_served_numbers_are_finite(spark):
    df = spark.createDataFrame(
        [("A", x) for x in (1.5, float("nan"), float("inf"), float("-inf"), None)],
        "ticker string, pre_return double")
    for c in ("event_id", "event_date", "fiscal_quarter", "cap_bucket"):
        df = df.withColumn(c, F.lit("x"))
    for c in ("day0_return", "post_return", "event_close", "avg_pre_volume_ratio",
              "avg_post_volume_ratio"):
        df = df.withColumn(c, F.lit(1).cast("decimal(10,4)"))
    got = serve.served(df, serve.EVENT_ROW)
    assert [r["pre_return"] for r in got.collect()] == [1.5, None, None, None, None]
    assert got.schema["event_close"].dataType.typeName() == "double"


def test_kept_tables_are_read_again_after_reload(spark, run, tmp_path):
    cohorts = serve.GoldTables(spark, run[0].gold).cohorts()
    cohorts.write.parquet(f"{tmp_path}/daily_cohort_metrics")
    gold = serve.GoldTables(spark, str(tmp_path), keep=True)
    assert gold.cohorts().count() == 33 and gold.cohorts().is_cached
    # A file that arrives from outside this session.
    (part,) = (tmp_path / "daily_cohort_metrics").glob("*.parquet")
    shutil.copy(part, part.with_name("part-copy.parquet"))
    assert gold.cohorts().count() == 33
    gold.reload()
    assert gold.cohorts().count() == 66
    gold.reload()


def test_on_demand_only_for_tickers_without_gold(spark, run, sf_dir):
    gold = serve.GoldTables(spark, run[0].gold)
    bars = tables.bars(spark, sf_dir)
    (absent, present) = (r[0] for r in bars.select("ticker").distinct().orderBy("ticker").take(2))
    others = F.col("ticker") != absent
    stored = gold.event_summary().filter(others)
    args = (tables.timed_announcements(spark, sf_dir), bars, datetime(2001, 4, 3), STUDY)
    own = serve.events_or_on_demand(stored, *args, ticker=absent.lower())
    assert own.count() > 0 and {r["ticker"] for r in own.collect()} == {absent}
    other = serve.events_or_on_demand(stored, *args, ticker=present)
    assert other.count() == stored.filter(F.col("ticker") == present).count()
    both = serve.events_or_on_demand(stored, *args)
    assert both.count() == stored.count() + own.count()
    days = gold.event_day_metrics().filter(others)
    window = serve.window_or_on_demand(days, *args, ticker=absent)
    assert window.filter(~F.col("relative_day").between(-5, 5)).isEmpty() and window.count() > 0


def test_every_landed_ticker_is_kept_unless_some_are_named(spark, tmp_path):
    bars_ = raw_bars(spark, ("AAPL", "2020-01-02", 1.0, 1.0, 1.0, 1.0, 5), ("ELSE", "2020-01-02", 1.0, 1.0, 1.0, 1.0, 5))
    events_ = spark.createDataFrame([("ELSE", "2020-01-03", "e")], "ticker string, event_date string, event_id string")
    every = Pipeline(spark, str(tmp_path / "every"))
    assert every.run(bars_, events_, datetime(2024, 1, 1))["silver"] == {"prices": 2, "announcements": 1}
    some = Pipeline(spark, str(tmp_path / "some"))
    named = spark.createDataFrame([("AAPL",), ("AAPL",)], "ticker string")
    assert some.load_bronze(bars_, events_, datetime(2024, 1, 1), named) == {"prices": 1, "announcements": 0}
    lines = spark.read.json(f"{some.bronze}/_manifest").collect()
    assert sorted(len(r["tickers"]) for r in lines) == [0, 1] and ["AAPL"] in [r["tickers"] for r in lines]


def test_a_correction_that_landed_later_wins(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    events_ = spark.createDataFrame([], "ticker string, event_date string, event_id string")
    for price in (9.0, 8.0):
        raw_bars(spark, ("A", "2020-01-02", price, price, price, price, 5)).write.mode("append").parquet(inbox)
        time.sleep(1.1)
    run_ = Pipeline(spark, str(tmp_path / "run"))
    run_.load_bronze(read_bars(spark, inbox), events_, datetime(2024, 1, 1))
    latest = clean_bars(read_layer(spark, f"{run_.bronze}/prices", LANDED_BARS), latest_by=["landed_at"])
    assert [float(r["close"]) for r in latest.collect()] == [8.0]


def test_stages_from_the_command_line(spark, tmp_path):
    from eventide.__main__ import main

    raw_bars(spark, ("A", "2020-01-02", 1.0, 1.0, 1.0, 1.0, 5), ("B", "2020-01-02", 1.0, 1.0, 1.0, 1.0, 5)
             ).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("A", "2020-01-02", None)], "ticker string, event_date string, event_id string"
                          ).write.parquet(str(tmp_path / "e"))
    root = ["--root", str(tmp_path / "layers")]
    loaded = main(["bronze", *root, "--prices", str(tmp_path / "p"), "--announcements", str(tmp_path / "e"),
                   "--tickers", "A"])
    assert loaded == {"prices": 1, "announcements": 1}
    assert main(["silver", *root]) == {"prices": 1, "announcements": 1}
    assert main(["sessions", *root]) == {"trade_sessions": 4, "distinct_sessions": 4}
    with pytest.raises(SystemExit):
        main(["all", *root])
