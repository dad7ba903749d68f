"""Lookups over the gold tables. All return lazy DataFrames; an unknown ticker or event is empty."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.config import TICKER_CHIPS, StudyConfig
from eventide.operators.trading import on_demand_study
from eventide.schemas import (
    COHORT_ROW,
    COHORTS,
    COHORT_STATE,
    EVENT_DAY_METRICS,
    EVENT_ROW,
    EVENT_SUMMARY,
    TICKER_EVENT_ROW,
    TICKER_ROW,
    WINDOW_ROW,
    served,
)
from eventide.sources.layers import read_layer
from eventide.sources.snapshots import Snapshot, current


class GoldTables:
    """The gold tables under one root; a missing table reads as empty.

    All lookups see the versions that were current when the object was made, until `reload` takes
    up later ones. ``keep=True`` caches each table on first use. Frames are kept by version: a lookup
    that is running while others reload goes on with the rows it began with, which stay cached until
    the reload after. Leave it off for tables larger than executor storage: partition pruning makes
    single-ticker lookups cheap without it.
    """

    _TABLES = {
        "event_summary": EVENT_SUMMARY,
        "event_day_metrics": EVENT_DAY_METRICS,
        "daily_cohort_metrics": COHORTS,
        "cohort_state": COHORT_STATE,
    }

    def __init__(self, spark: SparkSession, root: str, keep: bool = False) -> None:
        self._spark, self._root, self._keep = spark, root, keep
        self._kept: dict[tuple[str, int | None], DataFrame] = {}
        self._leaving: list[DataFrame] = []
        self._versions = self._current()

    def _current(self) -> dict[str, Snapshot | None]:
        return {name: current(self._spark, f"{self._root}/{name}") for name in self._TABLES}

    def versions(self) -> dict[str, int | None]:
        """Number of the version of each table that lookups see; None for a table without any."""
        return {name: version and version.id for name, version in self._versions.items()}

    def _table(self, name: str) -> DataFrame:
        version = self._versions[name]
        key = (name, version and version.id)
        if key in self._kept:
            return self._kept[key]
        frame = read_layer(self._spark, f"{self._root}/{name}", self._TABLES[name], missing_ok=True,
                           version=version)
        if self._keep:
            self._kept[key] = frame.cache()
        return frame

    def event_summary(self) -> DataFrame:
        return self._table("event_summary")

    def event_day_metrics(self) -> DataFrame:
        return self._table("event_day_metrics")

    def cohorts(self) -> DataFrame:
        return self._table("daily_cohort_metrics")

    def cohort_state(self) -> DataFrame:
        """What each ticker adds to the cohorts; `cohorts.merged_state` makes cohorts of any tickers."""
        return self._table("cohort_state")

    def reload(self) -> None:
        """Take up the latest version of each table; of unchanged ones kept rows stay kept.

        A folder without versions may have changed in place, so it is read anew.
        """
        self._versions = self._current()
        still = {(name, version.id) for name, version in self._versions.items() if version}
        for frame in self._leaving:
            frame.unpersist()
        self._leaving = []
        for key in [k for k in self._kept if k not in still]:
            frame = self._kept.pop(key)
            if key[1] is None:
                frame.unpersist()
            else:
                self._leaving.append(frame)
        for name, version in self._versions.items():
            if version is None:
                self._spark.catalog.refreshByPath(f"{self._root}/{name}")


def of_ticker(df: DataFrame, ticker: str | None) -> DataFrame:
    """Rows of one ticker, trimmed and upper-cased; all rows for None."""
    return df if ticker is None else df.filter(F.col("ticker") == ticker.strip().upper())


def ticker_list(summary: DataFrame) -> DataFrame:
    """Every ticker with its bucket and number of events, by ticker."""
    per_ticker = summary.filter(F.col("ticker").isNotNull()).groupBy("ticker").agg(
        F.min("cap_bucket").alias("cap_bucket"), F.count("event_id").alias("event_count"))
    return served(per_ticker, TICKER_ROW).orderBy("ticker")


def ticker_chips(summary: DataFrame, first: int = TICKER_CHIPS) -> DataFrame:
    """The first few tickers of the list."""
    return ticker_list(summary).limit(first)


def _newest(rows: DataFrame, limit: int | None) -> DataFrame:
    """Newest ``limit`` events of each ticker, all by default, with their number and bucket."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    own = Window.partitionBy("ticker")
    newest = own.orderBy(F.desc("event_date"), "event_id")
    ranked = rows.withColumn("_rank", F.row_number().over(newest))
    top = ranked if limit is None else ranked.filter(F.col("_rank") <= limit)
    return top.withColumns({
        "event_count": F.count("*").over(own),
        "ticker_cap_bucket": F.min_by("cap_bucket", "_rank").over(own),
    })


def ticker_events(
    summary: DataFrame, ticker: str | None = None, limit: int | None = None
) -> DataFrame:
    """Newest events of a ticker, or of each ticker; all of them without a ``limit``.

    ``event_count`` counts the returned events and ``ticker_cap_bucket`` is that of the newest.
    The rank filter is applied before the shuffle too, so at most ``limit`` rows per ticker and
    task are sent.
    """
    top = _newest(of_ticker(summary, ticker), limit)
    return served(top, TICKER_EVENT_ROW).orderBy("ticker", F.desc("event_date"), "event_id")


def window_rows(
    day_rows: DataFrame, ticker: str | None = None, event_id: str | None = None
) -> DataFrame:
    """Day-level rows of a ticker, or of one of its events, in no order: what curves are made of."""
    rows = of_ticker(day_rows, ticker)
    if event_id:
        rows = rows.filter(F.col("event_id") == event_id)
    return served(rows, WINDOW_ROW)


def ticker_window(
    day_rows: DataFrame, ticker: str | None = None, event_id: str | None = None
) -> DataFrame:
    """`window_rows` by event and relative day."""
    return window_rows(day_rows, ticker, event_id).orderBy("event_id", "relative_day")


def cohort_rows(cohorts: DataFrame, cap_bucket: str | None = None) -> DataFrame:
    """Cohort metrics, optionally of one bucket, by relative day and bucket."""
    rows = cohorts
    if cap_bucket:
        rows = rows.filter(F.col("cap_bucket") == cap_bucket.upper())
    return served(rows, COHORT_ROW).orderBy("relative_day", "cap_bucket")


def return_curve(window_rows: DataFrame) -> DataFrame:
    """Mean cumulative return per relative day, in percent; null for a day without values."""
    mean = F.avg(F.col("cum_return").cast("double"))
    return (
        window_rows.groupBy(F.col("relative_day").alias("day"))
        .agg(F.round(mean * 100, 3).alias("avg_return"))
        .orderBy("day")
    )


def volume_curve(window_rows: DataFrame) -> DataFrame:
    """Mean volume ratio per relative day; null for a day without values."""
    return (
        window_rows.groupBy(F.col("relative_day").alias("day"))
        .agg(F.round(F.avg("volume_ratio"), 3).alias("volume_ratio"))
        .orderBy("day")
    )


def window_event_count(window_rows: DataFrame) -> DataFrame:
    """Number of distinct events behind a curve."""
    return window_rows.agg(F.count_distinct("event_id").alias("event_count"))


def _study_of_missing(known: DataFrame, events: DataFrame, bars: DataFrame, as_of: datetime,
                      config: StudyConfig, ticker: str | None) -> tuple[DataFrame, DataFrame]:
    # Only tickers without gold rows are studied: both inputs are cut down to them before the work.
    missing = of_ticker(events, ticker).join(
        of_ticker(known, ticker).select("ticker").distinct(), "ticker", "left_anti")
    own_bars = of_ticker(bars, ticker)
    if ticker is None:
        own_bars = own_bars.join(missing.select("ticker").distinct(), "ticker", "left_semi")
    return on_demand_study(missing, own_bars, as_of, config)


def events_or_on_demand(
    gold_summary: DataFrame, events: DataFrame, bars: DataFrame, as_of: datetime,
    config: StudyConfig = StudyConfig(), ticker: str | None = None,
) -> DataFrame:
    """Event summaries from gold, and from a trading-day study for tickers gold lacks."""
    summary, _ = _study_of_missing(gold_summary, events, bars, as_of, config, ticker)
    return served(of_ticker(gold_summary, ticker), EVENT_ROW).unionByName(served(summary, EVENT_ROW))


def window_or_on_demand(
    gold_days: DataFrame, events: DataFrame, bars: DataFrame, as_of: datetime,
    config: StudyConfig = StudyConfig(), ticker: str | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Day-level rows from gold, and from a trading-day study for tickers gold lacks.

    ``known`` holds the tickers in gold; the summary is the shortest table that does.
    """
    known = gold_days if known is None else known
    _, windows = _study_of_missing(known, events, bars, as_of, config, ticker)
    return served(of_ticker(gold_days, ticker), WINDOW_ROW).unionByName(served(windows, WINDOW_ROW))


def events_of_ticker(
    gold_summary: DataFrame, events: DataFrame, bars: DataFrame, as_of: datetime,
    config: StudyConfig = StudyConfig(), *, ticker: str, limit: int | None = None,
) -> DataFrame:
    """Newest events of a ticker, from gold or else studied: `ticker_events` wherever they come from."""
    rows = events_or_on_demand(gold_summary, events, bars, as_of, config, ticker)
    return served(_newest(rows, limit), TICKER_EVENT_ROW).orderBy(F.desc("event_date"), "event_id")


def windows_of_ticker(
    gold_days: DataFrame, gold_summary: DataFrame, events: DataFrame, bars: DataFrame,
    as_of: datetime, config: StudyConfig = StudyConfig(), *, ticker: str,
    event_id: str | None = None, in_order: bool = True,
) -> DataFrame:
    """Day-level rows of a ticker or one of its events, from gold or else studied.

    ``in_order=False`` leaves out the sort, for rows that are aggregated.
    """
    rows = window_or_on_demand(gold_days, events, bars, as_of, config, ticker, gold_summary)
    if event_id:
        rows = rows.filter(F.col("event_id") == event_id)
    return rows.orderBy("event_id", "relative_day") if in_order else rows
