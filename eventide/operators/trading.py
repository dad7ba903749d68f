"""Trading-day event study: for events with a time of day and prices outside the gold tables.

Day 0 is the trading day nearest to the event, and the window is counted in trading days.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.config import StudyConfig
from eventide.functions import cap_bucket, event_key, pandas_change, quarter_label, whole_days
from eventide.operators.clean import latest_per_key
from eventide.operators.metrics import sides

_EVENT = ["ticker", "event_ts"]
# Copies of a row that are spelled out in one place.
_COPIES_AT_ONCE = 1024


def price_points(bars: DataFrame, start: date, as_of: datetime) -> DataFrame:
    """Close and volume per trading day, from ``start`` to ``as_of``: one row per ticker and day.

    Copies of a bar combine before their shuffle; of different ones that of the greatest close stays.
    """
    points = bars.select(
        "ticker",
        F.col("trade_date").cast("date").alias("trade_date"),
        F.col("close").cast("double").alias("close"),
        "volume",
    ).filter(F.col("trade_date").between(F.lit(start), F.lit(as_of.date())))
    return latest_per_key(points, ["trade_date", "ticker"])


def timed_events(events: DataFrame, start: date, as_of: datetime) -> DataFrame:
    """Distinct (ticker, event_ts) up to ``as_of``, with how often each occurred.

    A time zone is dropped, the wall time kept, so ``event_ts`` compares with midnights. However
    often an event occurred, it is studied once, and spelled out at the end.
    """
    stamp = F.col("event_ts").cast("timestamp_ntz").cast("timestamp")
    return (
        events.select("ticker", stamp.alias("event_ts"))
        .filter(F.col("event_ts").between(
            F.lit(start).cast("timestamp"),
            F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp")))
        .groupBy("ticker", "event_ts")
        .agg(F.count("*").alias("copies"))
    )


def aligned_days(
    events: DataFrame, points: DataFrame, config: StudyConfig = StudyConfig()
) -> DataFrame:
    """Trading days near each event with their position relative to the nearest one.

    Each event names the calendar days within the span it could match, so the range join becomes
    an equality join on (ticker, trade_date): no key gathers a ticker's whole history.
    Events with fewer than ``min_bars`` days in the span are left out.
    """
    span = config.nearest_span_days
    midnight = F.date_trunc("day", "event_ts")
    past_midnight = (F.col("event_ts") > midnight).cast("int")
    first = F.date_add(F.to_date("event_ts"), past_midnight - span)
    last = F.date_add(F.to_date("event_ts"), span)
    candidates = events.withColumn("trade_date", F.explode(F.sequence(first, last)))

    event = Window.partitionBy(*_EVENT)
    in_order = event.orderBy("trade_date", "close", "volume")
    distance = F.abs(whole_days(F.col("trade_date").cast("timestamp"), F.col("event_ts")))
    return (
        candidates.join(points, ["ticker", "trade_date"])
        .withColumn("_position", F.row_number().over(in_order))
        .withColumns({
            "_bars": F.count("*").over(event),
            "_day_zero": F.min_by("_position", F.struct(distance, "_position")).over(event),
        })
        .filter(F.col("_bars") >= config.min_bars)
        .withColumn("relative_day", F.col("_position") - F.col("_day_zero"))
        .drop("_position", "_bars", "_day_zero")
    )


def nearest_trading_day(aligned: DataFrame) -> DataFrame:
    """Day 0 of each event."""
    return aligned.filter(F.col("relative_day") == 0)


def trading_windows(
    aligned: DataFrame, config: StudyConfig = StudyConfig(), pad_closes: bool = False
) -> DataFrame:
    """Day-level returns over the trading days around day 0.

    A null close gives null returns on its day and the next; ``pad_closes=True`` carries the last
    close forward instead. The running return is null where the daily return is.
    """
    event = Window.partitionBy(*_EVENT)
    in_order = event.orderBy("trade_date", "close", "volume")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    close = F.last("close", ignorenulls=True).over(so_far) if pad_closes else F.col("close")
    day = F.to_date("event_ts")
    return (
        aligned.filter(F.col("relative_day").between(-config.days_before, config.days_after))
        .withColumns({"_close": close, "_mean_volume": F.avg("volume").over(event)})
        .withColumn("_previous", F.lag("_close").over(in_order))
        .withColumn("daily_return", pandas_change(F.col("_close"), F.col("_previous")))
        .withColumn("cum_return",
                    F.when(F.col("daily_return").isNotNull(), F.sum("daily_return").over(so_far)))
        .withColumn("volume_ratio",
                    F.when(F.col("_mean_volume") > 0, F.col("volume") / F.col("_mean_volume")))
        .select(
            *_EVENT,
            event_key(F.col("ticker"), day).alias("event_id"),
            day.alias("event_date"),
            quarter_label(day).alias("fiscal_quarter"),
            cap_bucket("ticker", config.large_cap, config.mid_cap,
                       blank_as_other=False, strip=False).alias("cap_bucket"),
            "copies", "trade_date", "relative_day", "daily_return", "cum_return", "volume_ratio",
            "close",
        )
    )


def trading_summary(windows: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """One row per event. A side with rows but no returns sums to 0, a side without rows to null."""
    before, on_day, after = sides(config.days_before, config.days_after)
    daily, ratio, close = F.col("daily_return"), F.col("volume_ratio"), F.col("close")

    def side_sum(side):
        return F.when(F.count_if(side) > 0, F.coalesce(F.sum(F.when(side, daily)), F.lit(0.0)))

    return windows.groupBy(
        *_EVENT, "event_id", "event_date", "fiscal_quarter", "cap_bucket", "copies"
    ).agg(
        side_sum(before).alias("pre_return"),
        F.max(F.when(on_day, daily)).alias("day0_return"),
        side_sum(after).alias("post_return"),
        F.max(F.when(on_day, close)).alias("event_close"),
        F.avg(F.when(before, ratio)).alias("avg_pre_volume_ratio"),
        F.avg(F.when(after, ratio)).alias("avg_post_volume_ratio"),
    )


def repeat_copies(df: DataFrame) -> DataFrame:
    """Give an event that occurred several times its rows that often, as the input had it.

    A row first becomes one row per thousand copies, and these are dealt out over all tasks before
    they are spelled out: one event with most of the copies keeps every task equally busy. The
    number of tasks is named, because by the few bytes dealt out AQE would join them to one.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c for c in (*_EVENT, "trade_date") if c in df.columns]
    first = F.lit(0).cast("long")
    in_part = F.least(F.col("copies") - F.col("_part") * _COPIES_AT_ONCE, F.lit(_COPIES_AT_ONCE).cast("long"))
    return (
        df.withColumn("_part", F.explode(F.sequence(first, F.expr(f"(copies - 1) div {_COPIES_AT_ONCE}"))))
        .repartition(tasks, *keys, "_part")
        .withColumn("_copy", F.explode(F.sequence(first, in_part - 1)))
        .drop("_part", "_copy", "copies")
    )


def on_demand_study(
    events: DataFrame,
    bars: DataFrame,
    as_of: datetime,
    config: StudyConfig = StudyConfig(),
    pad_closes: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(summary, windows) of every ticker in one plan."""
    points = price_points(bars, config.start, as_of)
    timed = timed_events(events, config.start, as_of)
    windows = trading_windows(aligned_days(timed, points, config), config, pad_closes)
    return repeat_copies(trading_summary(windows, config)), repeat_copies(windows)
