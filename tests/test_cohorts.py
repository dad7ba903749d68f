"""Exact quantiles against sorted lists, and merged cohort states against whole cohorts."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from eventide.operators import cohorts
from eventide.operators.metrics import cohort_metrics
from eventide.sources.layers import stored

SCHEMA = ("ticker string, relative_day int, cap_bucket string, close decimal(12,4), "
          "daily_return decimal(30,17), volume_ratio double")


def lower(values, share):
    return sorted(values)[math.ceil(share * len(values)) - 1]


@pytest.mark.parametrize("share", [0.5, 0.01, 1.0])
def test_exact_quantiles(spark, share):
    rng = random.Random(3)
    groups = {
        "one": [7], "equal": [5] * 40, "two": [1, 2], "few": [3, 1, 2, 2, 9],
        "far": [10**11, 10**11 + 1, 10**11 + 2, -(10**11)], None: [rng.randrange(10**6) for _ in range(501)],
        "close": [10**10 + rng.randrange(50) for _ in range(400)], "ties": [rng.choice([1, 4, 4, 8]) for _ in range(99)],
    }
    rows = [(g, Decimal(v) / 10**5) for g, vs in groups.items() for v in vs] + [("one", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, x decimal(30,17)").repartition(5)
    got = {r.g: r.x for r in cohorts.exact_quantile(df, ["g"], "x", stored, share, bins=8).collect()}
    assert got == {g: Decimal(lower(vs, share)) / 10**5 for g, vs in groups.items()}


def days_of(spark, n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        value = Decimal(rng.randrange(-10**6, 10**6)) / 10**7
        rows.append((f"T{rng.randrange(9)}", rng.randrange(3), rng.choice(["LARGE", None]),
                     None if i % 11 == 0 else Decimal(5), None if i % 7 == 0 else value,
                     None if i % 5 == 0 else rng.random()))
    rows.append(("T0", 9, "MID", Decimal(5), None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_states_merge_in_any_parts(spark):
    days = days_of(spark, 3000)
    want = {(r.relative_day, r.cap_bucket): r for r in cohort_metrics(days).collect()}
    by_ticker = cohorts.cohort_state(days)
    halves = [cohorts.merged_state(by_ticker.filter((F.col("ticker") < "T4") == F.lit(x))) for x in (True, False)]
    twice = cohorts.merged_state(halves[0].unionByName(halves[1]))
    for state in (cohorts.merged_state(by_ticker), twice, cohorts.cohort_state(days, by=())):
        rows = cohorts.metrics_of_state(state).collect()
        assert len(rows) == len(want)
        for r in rows:
            whole = want[r.relative_day, r.cap_bucket]
            assert (r.event_count, r.avg_return, r.positive_rate) == (
                whole.event_count, whole.avg_return, whole.positive_rate)
            assert (r.avg_volume_ratio is None) == (whole.avg_volume_ratio is None)
            if r.avg_volume_ratio is not None:
                assert abs(r.avg_volume_ratio - whole.avg_volume_ratio) <= Decimal("0.0001")


def test_sketched_medians_are_near_in_rank(spark):
    n = 60_000
    days = spark.range(n).select(
        F.concat(F.lit("T"), F.col("id") % 40).alias("ticker"), F.lit(0).alias("relative_day"),
        F.lit("MID").alias("cap_bucket"), F.lit(1).cast("decimal(12,4)").alias("close"),
        ((F.col("id") * 7919 % n) / F.lit(float(n))).cast("decimal(30,17)").alias("daily_return"),
        F.lit(1.0).alias("volume_ratio"))
    (row,) = cohorts.metrics_of_state(cohorts.merged_state(cohorts.cohort_state(days))).collect()
    assert abs(float(row.median_return) - 0.5) < cohorts.RANK_ERROR


def test_exact_cohorts_are_the_cohorts(spark):
    days = days_of(spark, 2000, seed=2)
    exact, plain = cohorts.exact_cohorts(days, stored), cohort_metrics(days)
    assert exact.columns == plain.columns
    assert exact.exceptAll(plain).isEmpty() and plain.exceptAll(exact).isEmpty()


def test_no_round_sorts_values(spark):
    days = days_of(spark, 50)
    text = cohorts.exact_quantile(days, ["cap_bucket"], "daily_return", stored)._jdf.queryExecution().toString()
    assert "Sort" not in text
