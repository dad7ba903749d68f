"""Calendar-day event windows: expand, attach bars, compute returns.

A window holds at most ``days_before + days_after + 1`` rows, so no group grows with the data, and
after the join everything runs on one exchange by (ticker, event_id).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.config import ANALYSIS_END, DAYS_AFTER, DAYS_BEFORE, StudyConfig
from eventide.schemas import PRICE

_BAR_COLUMNS = ("trade_date", "open", "high", "low", "close", "volume")


def event_days(
    events: DataFrame,
    analysis_end: date = ANALYSIS_END,
    days_before: int = DAYS_BEFORE,
    days_after: int = DAYS_AFTER,
) -> DataFrame:
    """One row per event and calendar day of its window, which stops at ``analysis_end``."""
    first = F.date_sub("event_date", days_before)
    last = F.least(F.date_add("event_date", days_after), F.lit(analysis_end))
    return (
        events.filter(first < last)
        .select("event_id", "ticker", "event_date", "fiscal_quarter", "cap_bucket",
                F.explode(F.sequence(first, last)).alias("day"))
        .withColumn("relative_day", F.date_diff("day", "event_date"))
    )


def attach_bars(days: DataFrame, bars: DataFrame) -> DataFrame:
    """Left join of bars on ticker and day: days without trading keep null bar columns.

    Bars are cut down to the wanted days first. Where the days are few that join is a broadcast, and
    of all bars only those of some event reach the shuffle.
    """
    wanted = days.select("ticker", "day").distinct()
    priced = bars.select("ticker", F.col("trade_date").alias("day"), *_BAR_COLUMNS).join(
        wanted, ["ticker", "day"], "left_semi")
    columns = [*days.columns, *_BAR_COLUMNS]
    return days.join(priced, ["ticker", "day"], "left").select(*columns)


def returns(priced_days: DataFrame) -> DataFrame:
    """Daily return, running return and volume ratio within each event.

    The previous close is that of the previous row: a day after a gap has no return, nor has the
    first day of a window. The running return is a plain sum that carries over gaps.
    """
    event = Window.partitionBy("ticker", "event_id")
    by_day = event.orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast(PRICE)
    return (
        priced_days
        .withColumns({
            "_previous": F.lag("close").over(by_day),
            "_mean_volume": F.avg("volume").over(event),
        })
        .withColumns({
            "daily_return":
                (F.col("close") - F.col("_previous")) / F.nullif(F.col("_previous"), zero),
            "volume_ratio":
                F.when(F.col("_mean_volume") > 0, F.col("volume") / F.col("_mean_volume")),
        })
        .withColumn("cum_return", F.sum("daily_return").over(so_far))
        .select(*priced_days.columns, "daily_return", "cum_return", "volume_ratio")
    )


def event_day_metrics(
    events: DataFrame, bars: DataFrame, config: StudyConfig = StudyConfig()
) -> DataFrame:
    """The whole day-level study of cleaned events over cleaned bars."""
    days = event_days(events, config.end, config.days_before, config.days_after)
    # No window reaches past the analysis end, so later bars need not be read.
    needed = bars.filter(F.col("trade_date") <= F.lit(config.end))
    return returns(attach_bars(days, needed))
