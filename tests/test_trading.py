"""The trading-day study against a plain-Python reading of its rules."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from frames import bars, d, dicts, from_rows, ts

from eventide.config import StudyConfig
from eventide.operators import trading
from eventide.operators.trading import (
    aligned_days,
    nearest_trading_day,
    on_demand_study,
    price_points,
    repeat_copies,
    timed_events,
)
from pyspark.sql import functions as F
from pyspark.sql import types as T

AS_OF = ts("2024-12-31 12:00:00")
STUDY = StudyConfig()
POINTS = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("trade_date", T.DateType()),
    T.StructField("close", T.DoubleType()), T.StructField("volume", T.LongType())])


def timed(spark, *rows):
    return from_rows(spark, [(t, ts(x)) for t, x in rows], T.StructType([
        T.StructField("ticker", T.StringType()), T.StructField("event_ts", T.TimestampType())]))


def day_zero(spark, event, *days):
    b = bars(spark, *[("A", x, 10, 1) for x in days])
    aligned = aligned_days(timed_events(timed(spark, ("A", event)), STUDY.start, AS_OF),
                           price_points(b, STUDY.start, AS_OF))
    found = nearest_trading_day(aligned).collect()
    return str(found[0]["trade_date"]) if found else None


def test_tie_between_days_takes_the_earlier(spark):
    # A Sunday event, bars on Friday and Tuesday: two days either way.
    assert day_zero(spark, "2024-06-09", "2024-06-06", "2024-06-07", "2024-06-11") == "2024-06-07"


def test_event_late_in_the_day_belongs_to_the_next(spark):
    days = ("2024-06-11", "2024-06-12", "2024-06-13", "2024-06-14")
    assert day_zero(spark, "2024-06-12 16:00:00", *days) == "2024-06-13"
    assert day_zero(spark, "2024-06-12", *days) == "2024-06-12"
    assert day_zero(spark, "2024-06-12 00:00:00.500000", *days) == "2024-06-13"


def test_span_counts_time_of_day(spark):
    around = ("2024-06-25", "2024-06-26")
    assert day_zero(spark, "2024-06-12", "2024-05-29", *around) == "2024-06-25"
    # 14 days before 16:00 starts after that midnight, so only two bars are left.
    assert day_zero(spark, "2024-06-12 16:00:00", "2024-05-29", *around) is None


def test_fewer_than_three_bars_skips_the_event(spark):
    assert day_zero(spark, "2024-06-12", "2024-06-12", "2024-06-13") is None


def test_range_of_events_and_prices(spark):
    rows = timed_events(
        timed(spark, ("A", "2017-12-31 23:59:59"), ("A", "2018-01-01"), ("A", "2024-12-31 12:00:00"),
              ("A", "2024-12-31 12:00:01"), ("A", "2018-01-01")), STUDY.start, AS_OF)
    assert [(str(r["event_ts"]), r["copies"]) for r in dicts(rows, "event_ts")] == [
        ("2018-01-01 00:00:00", 2), ("2024-12-31 12:00:00", 1)]
    b = bars(spark, ("A", "2017-12-29", 1, 1), ("A", "2024-12-31", 1, 1), ("A", "2025-01-02", 1, 1))
    assert [r["trade_date"] for r in dicts(price_points(b, STUDY.start, AS_OF))] == [d("2024-12-31")]


def test_zoned_event_times_keep_their_wall_time(spark):
    df = spark.createDataFrame([("A", "2024-06-12T16:00:00-04:00")], "ticker string, event_ts string")
    (row,) = timed_events(df, STUDY.start, AS_OF).collect()
    assert row["event_ts"] == ts("2024-06-12 16:00:00")


def test_many_copies_are_studied_once(spark):
    b = bars(spark, *[("A", f"2024-06-1{i}", 10 + i, 5) for i in range(5)])
    copies = timed(spark, ("A", "2024-06-12")).crossJoin(spark.range(25_000)).drop("id")
    counted = timed_events(copies, STUDY.start, AS_OF)
    (row,) = nearest_trading_day(aligned_days(counted, price_points(b, STUDY.start, AS_OF), STUDY)).collect()
    assert row["copies"] == 25_000
    summary, windows = on_demand_study(copies, b, AS_OF)
    assert summary.count() == 25_000 and windows.count() == 125_000


def test_ten_million_copies_keep_all_tasks_busy(spark):
    b = bars(spark, *[("A", f"2024-06-1{i}", 10 + i, 5) for i in range(5)])
    copies = spark.range(10_000_000).select(F.lit("A").alias("ticker"), F.lit(ts("2024-06-12")).alias("event_ts"))
    both = copies.unionByName(timed(spark, ("A", "2024-06-13")).select("ticker", "event_ts"))
    summary, _ = on_demand_study(both, b, AS_OF)
    sizes = sorted(r["count"] for r in summary.groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == 10_000_001
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 2049])
def test_copies_around_a_part(spark, n):
    df = spark.createDataFrame([("A", ts("2024-06-12"), n, 7), ("B", ts("2024-06-12"), 1, 8)],
                               "ticker string, event_ts timestamp, copies long, x int")
    repeated = repeat_copies(df)
    assert repeated.columns == ["ticker", "event_ts", "x"]
    assert {r["x"]: r["count"] for r in repeated.groupBy("x").count().collect()} == {7: n, 8: 1}


def test_copies_of_a_bar_are_one_day(spark):
    b = bars(spark, *[("A", f"2024-06-1{i}", 10 + i, 5) for i in range(5)])
    many = b.crossJoin(spark.range(1000)).drop("id")
    _, windows = on_demand_study(timed(spark, ("A", "2024-06-12")), many, AS_OF)
    assert [r["relative_day"] for r in windows.orderBy("relative_day").collect()] == [-2, -1, 0, 1, 2]


def test_repeated_events_give_repeated_rows(spark):
    b = bars(spark, *[("A", f"2024-06-1{i}", 10 + i, 5) for i in range(5)])
    summary, windows = on_demand_study(
        timed(spark, ("A", "2024-06-12"), ("A", "2024-06-12")), b, AS_OF)
    assert summary.count() == 2 and windows.count() == 10
    assert not {"copies", "batch"} & set(summary.columns + windows.columns)


def test_sums_are_zero_without_returns_and_null_without_rows(spark):
    points = [("A", d("2024-06-10"), None, 5), ("A", d("2024-06-11"), None, 5),
              ("A", d("2024-06-12"), 8.0, 5)]
    df = from_rows(spark, points, POINTS)
    summary, _ = on_demand_study(timed(spark, ("A", "2024-06-12")), df, AS_OF)
    (row,) = dicts(summary)
    assert row["pre_return"] == 0.0 and row["post_return"] is None
    assert row["day0_return"] is None and row["event_close"] == 8.0


def test_null_close_and_padding(spark):
    points = [("A", d(f"2024-06-1{i}"), c, 5) for i, c in enumerate((10.0, None, 20.0, 10.0))]
    df = from_rows(spark, points, POINTS)
    event = timed(spark, ("A", "2024-06-11"))
    _, plain = on_demand_study(event, df, AS_OF)
    rows = dicts(plain, "relative_day")
    assert [r["daily_return"] for r in rows] == [None, None, None, -0.5]
    assert [r["cum_return"] for r in rows] == [None, None, None, -0.5]
    _, padded = on_demand_study(event, df, AS_OF, pad_closes=True)
    rows = dicts(padded, "relative_day")
    assert [r["daily_return"] for r in rows] == [None, 0.0, 1.0, -0.5]
    assert [r["close"] for r in rows] == [10.0, None, 20.0, 10.0]


def test_zero_close_follows_ieee(spark):
    points = [("A", d(f"2024-06-1{i}"), c, 5) for i, c in enumerate((0.0, 0.0, 3.0, 6.0))]
    _, windows = on_demand_study(
        timed(spark, ("A", "2024-06-11")), from_rows(spark, points, POINTS), AS_OF)
    assert [r["daily_return"] for r in dicts(windows, "relative_day")] == [None, None, math.inf, 1.0]


def _brute(points, event):
    """Window of one event: list of (relative_day, day, return, running return, ratio)."""
    near = sorted(p for p in points
                  if event - timedelta(days=14) <= datetime.combine(p[0], datetime.min.time())
                  <= event + timedelta(days=14))
    if len(near) < 3:
        return None
    gaps = [abs((datetime.combine(p[0], datetime.min.time()) - event).days) for p in near]
    zero = gaps.index(min(gaps))
    window = near[max(0, zero - 5):zero + 6]
    volumes = [p[2] for p in window]
    mean = sum(volumes) / len(volumes)
    total, out = 0.0, []
    for i, (day, close, volume) in enumerate(window):
        ret = None if i == 0 else close / window[i - 1][1] - 1
        total += ret or 0.0
        out.append((i - min(zero, 5), day, ret, None if ret is None else total,
                    volume / mean if mean > 0 else None))
    return out


def _close(a, b):
    return a is b if a is None or b is None else math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_events_match_brute_force(spark, seed):
    rng = random.Random(seed)
    calendar = [date(2024, 1, 1) + timedelta(days=i) for i in range(120)]
    history = {t: [(x, rng.uniform(1, 9), rng.randint(0, 9)) for x in calendar if rng.random() < p]
               for t, p in (("A", 0.7), ("B", 0.15), ("C", 0.03))}
    stamps = {(rng.choice("ABC"), datetime(2024, 1, 1) + timedelta(
        days=rng.randint(0, 119), hours=rng.choice((0, 8, 16, 23)))) for _ in range(120)}
    b = from_rows(spark, [(t, *p) for t, rows in history.items() for p in rows], POINTS)
    event_rows = timed(spark, *[(t, str(x)) for t, x in sorted(stamps)])
    _, windows = on_demand_study(event_rows, b, AS_OF)
    got = {}
    for r in dicts(windows, "ticker", "event_ts", "relative_day"):
        got.setdefault((r["ticker"], r["event_ts"]), []).append(
            (r["relative_day"], r["trade_date"], r["daily_return"], r["cum_return"],
             r["volume_ratio"]))
    want = {key: _brute(history[key[0]], key[1]) for key in stamps}
    want = {k: v for k, v in want.items() if v}
    assert set(got) == set(want) and 20 < len(want) < len(stamps)
    for key, rows in want.items():
        assert [r[:2] for r in got[key]] == [r[:2] for r in rows], key
        assert all(_close(x, y) for a, b in zip(got[key], rows) for x, y in zip(a[2:], b[2:])), key
