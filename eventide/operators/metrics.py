"""Aggregates over day-level metrics: cohorts and event summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.config import DAYS_AFTER, DAYS_BEFORE
from eventide.schemas import PRICE, RATE, RATIO, RETURN


# Of the median's rank: exact for so many values, and off by one in so many beyond.
MEDIAN_ACCURACY = 10_000


def traded_days(day_metrics: DataFrame) -> DataFrame:
    """Days that cohorts are made of: those with a close."""
    return day_metrics.filter(F.col("close").isNotNull() & F.col("relative_day").isNotNull())


def cohort_metrics(
    day_metrics: DataFrame, dims: Sequence[str] = ("relative_day", "cap_bucket"),
    accuracy: int = MEDIAN_ACCURACY,
) -> DataFrame:
    """Reaction of all events by relative day and cohort, over days that traded.

    Rows are counted, and a day without a return counts as not positive.
    The median is an element of the data, the lower one of two; its rank is exact up to ``accuracy``
    values of a cohort and within one part in ``accuracy`` beyond (`cohorts.exact_cohorts` is exact).
    """
    traded = traded_days(day_metrics)
    rising = F.when(F.col("daily_return") > 0, 1).otherwise(0)
    return traded.groupBy(*dims).agg(
        F.count("*").alias("event_count"),
        F.avg("daily_return").try_cast(RETURN).alias("avg_return"),
        F.percentile_approx("daily_return", 0.5, accuracy).try_cast(RETURN).alias("median_return"),
        F.avg("volume_ratio").try_cast(RATIO).alias("avg_volume_ratio"),
        F.avg(rising).try_cast(RATE).alias("positive_rate"),
    )


def sides(days_before: int, days_after: int) -> tuple[Column, Column, Column]:
    """Predicates for the days before the event, the day itself and the days after it."""
    day = F.col("relative_day")
    return day.between(-days_before, -1), day == 0, day.between(1, days_after)


def event_summary(
    day_metrics: DataFrame, days_before: int = DAYS_BEFORE, days_after: int = DAYS_AFTER
) -> DataFrame:
    """One row per event with its return and volume before, on and after the day.

    One pass: each side is a conditional aggregate, so nothing is scanned three times or joined.
    Events without any row before the day have no summary; a side without returns has a null sum.
    """
    before, on_day, after = sides(days_before, days_after)
    daily, ratio = F.col("daily_return"), F.col("volume_ratio")
    keys = ["ticker", "event_id", "event_date", "fiscal_quarter", "cap_bucket"]
    return (
        day_metrics.groupBy(*keys)
        .agg(
            F.sum(F.when(before, daily)).try_cast(RETURN).alias("pre_return"),
            F.avg(F.when(before, ratio)).try_cast(RATIO).alias("avg_pre_volume_ratio"),
            F.max(F.when(on_day, daily)).try_cast(RETURN).alias("day0_return"),
            F.max(F.when(on_day, F.col("close"))).try_cast(PRICE).alias("event_close"),
            F.sum(F.when(after, daily)).try_cast(RETURN).alias("post_return"),
            F.avg(F.when(after, ratio)).try_cast(RATIO).alias("avg_post_volume_ratio"),
            F.count_if(before).alias("_before"),
        )
        .filter(F.col("_before") > 0)
        .drop("_before")
    )
