"""Cohorts in parts that can be merged, and exact medians without a sort.

The state of a cohort, such as one ticker's share of it, holds counts, sums and a quantile sketch.
States of disjoint rows merge into that of all of them, so new rows cost a state of their own and a
merge of small rows, not another pass over everything. Counts and means come out exact, the median
within a known error of its rank.

The exact median narrows down: values are counted in bins between the least and the greatest, the bin
that holds the wanted rank is the next range, and after a few rounds one value is left. Counts combine
before their shuffle, so no cohort is gathered or sorted, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.metrics import cohort_metrics, traded_days
from eventide.schemas import RATE, RATIO, RETURN

DIMS = ("relative_day", "cap_bucket")
# Size parameter of the sketches: the rank of a quantile is then off by less than ``RANK_ERROR``
# of all values, with 99 % probability.
SKETCH_K, RANK_ERROR = 800, 0.0045
# Bins of a round of the exact median.
BINS = 1024


def cohort_state(day_metrics: DataFrame, dims: Sequence[str] = DIMS, by: Sequence[str] = ("ticker",),
                 sketch_k: int = SKETCH_K) -> DataFrame:
    """What each of ``by`` adds to each cohort; without ``by``, whole cohorts."""
    daily = F.col("daily_return")
    return traded_days(day_metrics).groupBy(*by, *dims).agg(
        F.count("*").alias("days"),
        F.count("daily_return").alias("returns"),
        F.sum("daily_return").alias("return_sum"),
        F.count_if(daily > 0).alias("rising"),
        F.count("volume_ratio").alias("ratios"),
        F.sum("volume_ratio").alias("ratio_sum"),
        F.kll_sketch_agg_double(daily.cast("double"), sketch_k).alias("sketch"),
    )


def merged_state(states: DataFrame, dims: Sequence[str] = DIMS, sketch_k: int = SKETCH_K) -> DataFrame:
    """States of the cohorts by fewer dimensions, or of several parts of them."""
    counts = ("days", "returns", "return_sum", "rising", "ratios", "ratio_sum")
    return states.groupBy(*dims).agg(
        *[F.sum(c).alias(c) for c in counts], F.kll_merge_agg_double("sketch", sketch_k).alias("sketch"))


def metrics_of_state(state: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """`cohort_metrics` of whole cohorts, with the sketch's median."""
    median = F.when(F.col("returns") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)))
    return state.select(
        *dims, F.col("days").alias("event_count"),
        (F.col("return_sum") / F.nullif("returns", F.lit(0).cast("long"))).try_cast(RETURN).alias("avg_return"),
        median.try_cast(RETURN).alias("median_return"),
        (F.col("ratio_sum") / F.nullif("ratios", F.lit(0).cast("long"))).try_cast(RATIO).alias("avg_volume_ratio"),
        (F.col("rising") / F.col("days")).try_cast(RATE).alias("positive_rate"),
    )


def exact_quantile(rows: DataFrame, dims: Sequence[str], value: str, settle: Callable[[DataFrame], DataFrame],
                   share: float = 0.5, bins: int = BINS, most: int = 60) -> DataFrame:
    """(dims, value): the least element of each group that at least ``share`` of its values do not exceed.

    Nulls are left out; a group of nothing else has no row. ``settle`` stores a table and returns
    it, read back: each round starts from what the one before has written, one row per group.
    """
    values = settle(rows.select(*dims, value).filter(F.col(value).isNotNull()))
    names = [f"_{d}" for d in dims]
    ranges = settle(values.groupBy(*dims).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")
    ).select(*[F.col(d).alias(n) for d, n in zip(dims, names, strict=True)], "low", "high",
             F.lit(0).cast("long").alias("below"), F.ceil(F.col("n") * share).alias("rank")))
    same = F.lit(True)
    for d, n in zip(dims, names, strict=True):
        same = same & F.col(d).eqNullSafe(F.col(n))
    for _ in range(most):
        if ranges.filter(F.col("low") < F.col("high")).isEmpty():
            break
        inside = values.join(ranges, same).filter(F.col(value).between(F.col("low"), F.col("high")))
        counted = inside.groupBy(*names, "below", "rank", _bin(F.col(value), bins).alias("bin")).agg(
            F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))
        upwards = Window.partitionBy(*names).orderBy("bin")
        so_far = counted.withColumn("reached", F.col("below") + F.sum("n").over(upwards))
        ranges = settle(so_far.filter(F.col("reached").between(F.col("rank"), F.col("rank") + F.col("n") - 1)).select(
            *names, "low", "high", (F.col("reached") - F.col("n")).alias("below"), "rank"))
    else:
        raise RuntimeError(f"values not apart after {most} rounds")
    return ranges.select(*[F.col(n).alias(d) for d, n in zip(dims, names, strict=True)], F.col("low").alias(value))


def _bin(value: Column, bins: int) -> Column:
    """Rises with the value from 0, at "low", to ``bins`` - 1 at "high"."""
    width = (F.col("high") - F.col("low")).cast("double")
    at = F.floor((value - F.col("low")).cast("double") / F.nullif(width, F.lit(0.0)) * bins)
    return F.coalesce(F.least(at, F.lit(bins - 1).cast("long")), F.lit(0).cast("long"))


def exact_cohorts(day_metrics: DataFrame, settle: Callable[[DataFrame], DataFrame],
                  dims: Sequence[str] = DIMS) -> DataFrame:
    """`cohort_metrics` whose median is exact for cohorts of any size."""
    traded = traded_days(day_metrics)
    median = exact_quantile(traded, dims, "daily_return", settle).select(
        *[F.col(d).alias(f"_{d}") for d in dims], F.col("daily_return").try_cast(RETURN).alias("median_return"))
    same = F.lit(True)
    for d in dims:
        same = same & F.col(d).eqNullSafe(F.col(f"_{d}"))
    rest = cohort_metrics(day_metrics, dims)
    columns = rest.columns
    return rest.drop("median_return").join(median, same, "left").select(*columns)
