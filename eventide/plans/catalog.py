"""Every operator and user-facing query over the test tables, under a topic name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.functions import cap_bucket, exchange_date, finite_or_null, quarter_label
from eventide.functions import register_cap_bucket
from eventide.operators.clean import clean_announcements, clean_bars, latest_per_key
from eventide.operators import cohorts as cohorts_in_parts
from eventide.operators.metrics import cohort_metrics, event_summary, traded_days
from eventide.operators.quality import null_report
from eventide.operators.sessions import bar_sessions, bar_trades, session_counts, sessionize
from eventide.operators.trading import (
    aligned_days,
    nearest_trading_day,
    on_demand_study,
    price_points,
    timed_events,
)
from eventide.operators.windows import attach_bars, event_day_metrics, event_days
from eventide.plans import serve
from eventide.plans.pipeline import Pipeline
from eventide.schemas import RAW_BARS, TRADE_SESSIONS
from eventide.sources import tables as t
from eventide.sources.landed import in_range, only_tickers, read_announcements, read_bars, rejected
from eventide.sources.layers import read_layer, shared_folder, stored
from eventide.sources.manifest import MANIFEST, run_counts

STUDY = t.TABLE_STUDY
AS_OF = datetime(2001, 4, 3)
ONE_TICKER = "NATION_12"
STORED_TICKER = "NATION_3"
ONE_EVENT = "NATION_12_19980401"

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def _plain(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DecimalType | T.DoubleType | T.FloatType):
        # The nudge makes a tie at the last place round the same way whatever the summation order.
        value = column.cast("double")
        return F.round(value + F.signum(value) * 1e-10, 6) + F.lit(0.0)
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return column.cast("long") if isinstance(kind, T.IntegralType) else column


def plain(df: DataFrame) -> DataFrame:
    """Types every SQL engine shares: doubles to six places, text dates, long integers."""
    return df.select(*[_plain(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def _query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # The tables' timestamps have no zone; all queries read them as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return plain(build(spark, sf_dir))

    _REGISTRY[build.__name__] = run
    return build


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _days(spark: SparkSession, sf: str) -> DataFrame:
    return event_day_metrics(t.announcements(spark, sf), t.bars(spark, sf), STUDY)


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return event_summary(_days(spark, sf))


def _silver_bars(spark: SparkSession, sf: str) -> DataFrame:
    return clean_bars(t.vendor_bars(spark, sf), STUDY)


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    return aligned_days(
        timed_events(t.timed_announcements(spark, sf), STUDY.start, AS_OF),
        price_points(t.bars(spark, sf), STUDY.start, AS_OF),
        STUDY,
    )


def _on_demand(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return on_demand_study(t.timed_announcements(spark, sf), t.bars(spark, sf), AS_OF, STUDY)


# Sources and cleaning.

@_query
def daily_bars(spark, sf):
    return t.bars(spark, sf)


@_query
def announcements_in_range(spark, sf):
    return in_range(t.vendor_announcements(spark, sf), "event_date", STUDY.start, STUDY.end)


@_query
def ticker_subset(spark, sf):
    return only_tickers(t.vendor_announcements(spark, sf), ["NATION_3", "NATION_12", "NATION_21"])


@_query
def clean_prices(spark, sf):
    return _silver_bars(spark, sf)


@_query
def clean_events(spark, sf):
    return clean_announcements(t.vendor_announcements(spark, sf), STUDY)


@_query
def latest_line_per_key(spark, sf):
    return latest_per_key(t.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@_query
def ticker_buckets(spark, sf):
    """Both classifiers on padded, lower-cased, blank and null variants of every customer's nation."""
    nations = t.table(spark, sf, "nation").select("n_nationkey", "n_name")
    customers = t.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    kind = F.col("c_custkey") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("  "), F.lower("n_name"), F.lit("\t")))
        .when(kind == 1, F.lit("   "))
        .when(kind == 2, F.lit(None).cast("string"))
        .otherwise(F.col("n_name"))
    )
    named = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(
        "c_custkey",
        cap_bucket(text, STUDY.large_cap, STUDY.mid_cap).alias("bucket"),
        cap_bucket(text, STUDY.large_cap, STUDY.mid_cap, blank_as_other=False, strip=False)
        .alias("on_demand_bucket"),
    )


@_query
def bucket_sql_function(spark, sf):
    """The classifier called by name from a SQL expression."""
    register_cap_bucket(spark, "ticker_bucket", STUDY.large_cap, STUDY.mid_cap)
    return t.announcements(spark, sf).select("event_id", F.expr("ticker_bucket(ticker)").alias("bucket"))


@_query
def fiscal_quarter(spark, sf):
    orders = t.table(spark, sf, "orders")
    quarter = quarter_label(F.to_date("o_orderdate"))
    return orders.groupBy(quarter.alias("quarter")).agg(F.count("*").alias("orders"))


@_query
def local_date(spark, sf):
    day = F.to_date("o_orderdate")
    return t.table(spark, sf, "orders").select(day.alias("day")).distinct().select(
        "day",
        exchange_date(F.col("day"), STUDY.exchange_tz).alias("shifted"),
        exchange_date(F.col("day"), STUDY.exchange_tz, dates_are_local=True).alias("as_is"),
    )


@_query
def finite_values(spark, sf):
    raw = (
        F.when(F.col("event_type") == "error", F.lit(float("nan")))
        .when(F.col("event_type") == "purchase", F.lit(float("inf")))
        .when(F.col("value") < 1, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return t.table(spark, sf, "events").select("event_id", finite_or_null(raw).alias("value"))


# Calendar-day study.

@_query
def event_day_grid(spark, sf):
    return event_days(t.announcements(spark, sf), STUDY.end)


@_query
def event_day_prices(spark, sf):
    return attach_bars(event_days(t.announcements(spark, sf), STUDY.end), t.bars(spark, sf))


@_query
def daily_returns(spark, sf):
    return _days(spark, sf).select("ticker", "event_id", "relative_day", "daily_return")


@_query
def cum_returns(spark, sf):
    return _days(spark, sf).select("ticker", "event_id", "relative_day", "cum_return")


@_query
def volume_ratio(spark, sf):
    return _days(spark, sf).select("ticker", "event_id", "relative_day", "volume_ratio")


@_query
def event_day_study(spark, sf):
    return _days(spark, sf)


@_query
def study_of_cleaned_rows(spark, sf):
    """Cleaning and study in one plan, as over bronze tables."""
    events = clean_announcements(
        in_range(t.vendor_announcements(spark, sf), "event_date", STUDY.start, STUDY.end), STUDY)
    return event_summary(event_day_metrics(events, _silver_bars(spark, sf), STUDY))


@_query
def cohorts(spark, sf):
    return cohort_metrics(_days(spark, sf))


@_query
def cohorts_by_quarter(spark, sf):
    return cohort_metrics(_days(spark, sf), ["relative_day", "cap_bucket", "fiscal_quarter"])


@_query
def exact_cohorts(spark, sf):
    """The median by narrowing down, for cohorts of any size."""
    return cohorts_in_parts.exact_cohorts(_days(spark, sf), stored)


@_query
def merged_cohorts(spark, sf):
    """Cohorts merged from stored states of tickers; the sketched median's rank is checked."""
    days = _days(spark, sf)
    states = stored(cohorts_in_parts.cohort_state(days))
    merged = cohorts_in_parts.metrics_of_state(cohorts_in_parts.merged_state(states))
    near = traded_days(days).join(merged.select(*cohorts_in_parts.DIMS, "median_return"), list(cohorts_in_parts.DIMS))
    # Medians are rounded to six places.
    value, median = F.col("daily_return"), F.col("median_return")
    n = F.nullif(F.count("daily_return"), F.lit(0).cast("long"))
    ranks = near.groupBy(*cohorts_in_parts.DIMS).agg(
        (F.count_if(value < median - 1e-6) / n).alias("low"), (F.count_if(value <= median + 1e-6) / n).alias("high"))
    error = F.lit(cohorts_in_parts.RANK_ERROR)
    within = (F.col("low") <= 0.5 + error) & (F.col("high") >= 0.5 - error)
    return merged.drop("median_return").join(ranks, list(cohorts_in_parts.DIMS)).select(
        *merged.drop("median_return").columns, F.coalesce(within, F.lit(True)).alias("median_within_error"))


@_query
def event_summaries(spark, sf):
    return _summary(spark, sf)


# Sessions.

@_query
def intraday_rows(spark, sf):
    return bar_trades(_silver_bars(spark, sf))


@_query
def bar_trade_sessions(spark, sf):
    return bar_sessions(_silver_bars(spark, sf))


@_query
def trade_sessions(spark, sf):
    return sessionize(t.trades(spark, sf), tie_break=["trade_id"])


@_query
def session_totals(spark, sf):
    return session_counts(sessionize(t.trades(spark, sf), tie_break=["trade_id"]))


# Trading-day study.

@_query
def nearest_trading_days(spark, sf):
    return nearest_trading_day(_aligned(spark, sf)).drop("relative_day")


@_query
def trading_day_windows(spark, sf):
    return _on_demand(spark, sf)[1]


@_query
def trading_day_summaries(spark, sf):
    return _on_demand(spark, sf)[0]


# Lookups.

@_query
def ticker_list(spark, sf):
    return serve.ticker_list(_summary(spark, sf))


@_query
def ticker_chips(spark, sf):
    return serve.ticker_chips(_summary(spark, sf))


@_query
def ticker_events_top(spark, sf):
    return serve.ticker_events(_summary(spark, sf), limit=7)


@_query
def ticker_events_one(spark, sf):
    return serve.ticker_events(_summary(spark, sf), f" {ONE_TICKER.lower()} ")


@_query
def ticker_window_rows(spark, sf):
    return serve.ticker_window(_days(spark, sf), ONE_TICKER)


@_query
def event_window_rows(spark, sf):
    return serve.ticker_window(_days(spark, sf), ONE_TICKER, ONE_EVENT)


@_query
def cohort_rows(spark, sf):
    return serve.cohort_rows(cohort_metrics(_days(spark, sf)))


@_query
def cohort_rows_by_cap(spark, sf):
    return serve.cohort_rows(cohort_metrics(_days(spark, sf)), "mid")


@_query
def return_curve(spark, sf):
    return serve.return_curve(serve.window_rows(_days(spark, sf), ONE_TICKER))


@_query
def return_curve_one_event(spark, sf):
    return serve.return_curve(serve.window_rows(_days(spark, sf), ONE_TICKER, ONE_EVENT))


@_query
def volume_curve(spark, sf):
    return serve.volume_curve(serve.window_rows(_days(spark, sf), ONE_TICKER))


@_query
def curve_event_count(spark, sf):
    return serve.window_event_count(serve.window_rows(_days(spark, sf), ONE_TICKER))


def _large_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("cap_bucket") == "LARGE")


@_query
def gold_or_on_demand_events(spark, sf):
    """Gold holds the large caps; the others are studied on demand."""
    return serve.events_or_on_demand(
        _large_only(_summary(spark, sf)), t.timed_announcements(spark, sf), t.bars(spark, sf),
        AS_OF, STUDY)


@_query
def gold_or_on_demand_windows(spark, sf):
    return serve.window_or_on_demand(
        _large_only(_days(spark, sf)), t.timed_announcements(spark, sf), t.bars(spark, sf),
        AS_OF, STUDY)


def _lookup_inputs(spark: SparkSession, sf: str):
    """Gold of the large caps, and what the others are studied from."""
    return (_large_only(_summary(spark, sf)), t.timed_announcements(spark, sf), t.bars(spark, sf),
            AS_OF, STUDY)


@_query
def events_of_stored_ticker(spark, sf):
    return serve.events_of_ticker(*_lookup_inputs(spark, sf), ticker=STORED_TICKER, limit=5)


@_query
def events_of_studied_ticker(spark, sf):
    return serve.events_of_ticker(*_lookup_inputs(spark, sf), ticker=ONE_TICKER)


def _windows_of(spark: SparkSession, sf: str, ticker: str, **how) -> DataFrame:
    days = _large_only(_days(spark, sf))
    return serve.windows_of_ticker(days, *_lookup_inputs(spark, sf), ticker=ticker, **how)


@_query
def window_of_stored_ticker(spark, sf):
    return _windows_of(spark, sf, STORED_TICKER)


@_query
def window_of_studied_ticker(spark, sf):
    return _windows_of(spark, sf, ONE_TICKER)


@_query
def window_of_studied_event(spark, sf):
    return _windows_of(spark, sf, ONE_TICKER, event_id=ONE_EVENT)


@_query
def studied_return_curve(spark, sf):
    return serve.return_curve(_windows_of(spark, sf, ONE_TICKER, in_order=False))


@_query
def studied_volume_curve(spark, sf):
    return serve.volume_curve(_windows_of(spark, sf, ONE_TICKER, in_order=False))


# Layers written and read back.

EVERY_DAY = replace(STUDY, start=date(1900, 1, 1), end=date(2999, 12, 31))


def _stored(spark: SparkSession, sf: str) -> Pipeline:
    """A bronze load of all vendor rows, in a folder of its own."""
    run = Pipeline(spark, shared_folder(spark), EVERY_DAY)
    run.load_bronze(t.vendor_bars(spark, sf), t.vendor_announcements(spark, sf), datetime(2024, 1, 1))
    return run


@_query
def stored_bronze_prices(spark, sf):
    return read_layer(spark, f"{_stored(spark, sf).bronze}/prices", RAW_BARS)


@_query
def stored_silver_prices(spark, sf):
    run = _stored(spark, sf)
    run.build_silver()
    return run.silver_bars()


@_query
def stored_silver_announcements(spark, sf):
    run = _stored(spark, sf)
    run.build_silver()
    return run.silver_announcements()


@_query
def stored_sessions(spark, sf):
    run = _stored(spark, sf)
    run.build_silver()
    run.build_sessions()
    return read_layer(spark, f"{run.gold}/trade_sessions", TRADE_SESSIONS)


@_query
def stored_manifest(spark, sf):
    lines = spark.read.schema(MANIFEST).json(f"{_stored(spark, sf).bronze}/_manifest")
    return lines.select(F.explode("row_counts").alias("table_name", "row_count"))


@_query
def corrected_prices(spark, sf):
    """Line items as prices that correct each other, by a time of arrival."""
    price, hours = F.col("l_extendedprice"), F.make_interval(hours=F.col("l_linenumber"))
    landed = t.priced_lines(spark, sf).select(
        "ticker", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date"),
        *[price.alias(c) for c in ("open", "high", "low", "close")],
        F.col("l_quantity").cast("long").alias("volume"),
        (F.col("l_shipdate").cast("timestamp") + hours).alias("landed_at"))
    return clean_bars(landed, STUDY, ["landed_at"])


def _grown(spark: SparkSession, sf: str, between=lambda study: None) -> Pipeline:
    """All tables after two landings, the second merged into what the first had made of them.

    ``between`` is called after the first.
    """
    root = shared_folder(spark)
    landing, study = Pipeline(spark, root, EVERY_DAY), Pipeline(spark, root, STUDY)
    # Made once: each landing would join and aggregate the tables again, and filter every line item.
    bars, events = (stored(x) for x in (t.vendor_bars(spark, sf), t.vendor_announcements(spark, sf)))
    events = in_range(events, "event_date", STUDY.start, STUDY.end)
    # Later are half of the days of each month, for tickers whose number is odd.
    odd = F.regexp_extract("ticker", r"(\d+)$", 1).cast("int") % 2 == 1
    for n, late in enumerate((False, True), 1):
        part = [x.filter((odd & (F.substring(day, 9, 2) > "15")) == F.lit(late))
                for x, day in ((bars, "trade_date"), (events, "event_date"))]
        landing.land(*part, datetime(2024, 1, n))
        study.catch_up()
        if not late:
            between(study)
    return study


@_query
def upserted_prices(spark, sf):
    return _grown(spark, sf).silver_bars()


@_query
def upserted_event_summary(spark, sf):
    return serve.GoldTables(spark, _grown(spark, sf).gold).event_summary()


@_query
def served_after_reload(spark, sf):
    """Kept tables, looked up before and after they were written again."""
    held = []

    def look(study: Pipeline) -> None:
        gold = serve.GoldTables(spark, study.gold, keep=True)
        gold.event_summary().count()
        held.append(gold)

    _grown(spark, sf, look)
    held[0].reload()
    return held[0].event_summary()


def _stored_study(spark: SparkSession, sf: str) -> serve.GoldTables:
    """Gold tables of one run over everything."""
    root = shared_folder(spark)
    events = in_range(t.vendor_announcements(spark, sf), "event_date", STUDY.start, STUDY.end)
    landing, study = Pipeline(spark, root, EVERY_DAY), Pipeline(spark, root, STUDY)
    landing.load_bronze(t.vendor_bars(spark, sf), events, datetime(2024, 1, 1))
    study.build_silver()
    study.build_event_days()
    study.build_cohorts()
    return serve.GoldTables(spark, study.gold)


@_query
def served_event_summary(spark, sf):
    return _stored_study(spark, sf).event_summary()


@_query
def served_windows(spark, sf):
    return serve.window_rows(_stored_study(spark, sf).event_day_metrics())


@_query
def stored_cohorts(spark, sf):
    return _stored_study(spark, sf).cohorts()


# Landed files read back.

def _landed_csv(spark: SparkSession, sf: str) -> str:
    """Vendor bars as CSV, with volumes that are no number and closes that are NaN on some days."""
    day = F.substring("trade_date", 9, 2)
    bars = t.vendor_bars(spark, sf).withColumns({
        "volume": F.when(day == "13", F.lit("n/a")).otherwise(F.col("volume").cast("string")),
        "close": F.when(day == "07", F.lit("NaN")).otherwise(F.col("close").cast("string"))})
    path = shared_folder(spark)
    bars.write.csv(path, header=True)
    return path


@_query
def landed_csv_prices(spark, sf):
    return read_bars(spark, _landed_csv(spark, sf), "csv").drop("landed_at")


@_query
def landed_csv_rejects(spark, sf):
    return rejected(spark, _landed_csv(spark, sf), "csv", RAW_BARS).agg(F.count("*").alias("rejected"))


@_query
def landed_json_announcements(spark, sf):
    """Every other day's announcements come without an id, which is then built."""
    named = F.when(F.substring("event_date", 10, 1).cast("int") % 2 == 1, F.concat(F.lit("own_"), "event_id"))
    path = shared_folder(spark)
    t.vendor_announcements(spark, sf).withColumn("event_id", named).write.json(path)
    return read_announcements(spark, path, "json").drop("landed_at")


# Quality and run figures.

@_query
def stored_quality(spark, sf):
    """Figures that were taken while bronze and silver were written."""
    run = _stored(spark, sf)
    run.build_silver()
    return run.quality().filter("column_name <> 'landed_at'").drop("failed", "last_value")


@_query
def null_counts(spark, sf):
    return null_report(t.vendor_bars(spark, sf), "vendor_bars").unionByName(
        null_report(_days(spark, sf), "event_days"))


@_query
def run_figures(spark, sf):
    return run_counts(STUDY, prices=_silver_bars(spark, sf),
                      announcements=clean_announcements(t.vendor_announcements(spark, sf), STUDY))
