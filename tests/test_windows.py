from decimal import Decimal

from frames import bars, d, dec, dicts, events

from eventide.config import StudyConfig
from eventide.operators.metrics import cohort_metrics, event_summary
from eventide.operators.windows import event_day_metrics, event_days
from eventide.schemas import PRICE, RATIO, RETURN
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_full_and_clamped_windows(spark):
    end = d("2024-12-31")
    ev = events(spark, ("A", "2024-06-12"), ("A", "2024-12-29"), ("A", "2024-12-31"),
                ("A", "2025-01-05"), ("A", "2025-01-04"))
    rows = dicts(event_days(ev, end), "event_date", "day")
    by_event = {}
    for r in rows:
        by_event.setdefault(str(r["event_date"]), []).append(r["relative_day"])
    assert by_event == {
        "2024-06-12": list(range(-5, 6)),
        "2024-12-29": list(range(-5, 3)),
        "2024-12-31": list(range(-5, 1)),
        "2025-01-04": [-5, -4],   # starts before the end; one starting on it has no window
    }


def test_returns_over_a_weekend(spark):
    # Event on Monday; Saturday and Sunday have no bars.
    b = bars(spark, ("A", "2024-06-05", 10, 100), ("A", "2024-06-06", 11, 100),
             ("A", "2024-06-07", 12, 100), ("A", "2024-06-10", 15, 300), ("A", "2024-06-11", 12, 200),
             ("A", "2024-06-12", 12, 200), ("B", "2024-06-08", 99, 9))
    rows = dicts(event_day_metrics(events(spark, ("A", "2024-06-10")), b), "day")
    assert len(rows) == 11
    by_day = {r["relative_day"]: r for r in rows}
    assert by_day[-5]["daily_return"] is None                    # never looks before the window
    assert by_day[-4]["daily_return"] == dec("0.1").quantize(Decimal(10) ** -17)
    assert by_day[0]["daily_return"] is None                     # the day after a gap
    assert by_day[0]["cum_return"] == by_day[-3]["cum_return"]   # carried over the gap
    assert by_day[-5]["cum_return"] is None
    assert by_day[1]["daily_return"] == Decimal("-0.2")
    assert abs(by_day[2]["cum_return"] - Decimal("-0.0090909")) < Decimal("1e-6")
    assert abs(by_day[0]["volume_ratio"] - 300 / (1000 / 6)) < 1e-12
    assert by_day[-2]["trade_date"] is None and by_day[-2]["day"] == d("2024-06-08")


def test_width_of_return_columns(spark):
    df = event_day_metrics(events(spark), bars(spark))
    kinds = {f.name: f.dataType for f in df.schema}
    assert kinds["daily_return"] == T.DecimalType(30, 17)
    assert kinds["cum_return"] == T.DecimalType(38, 17)
    assert kinds["volume_ratio"] == T.DoubleType()


def test_zero_close_gives_null_not_an_error(spark):
    b = bars(spark, ("A", "2024-06-09", 0, 1), ("A", "2024-06-10", 5, 1), ("A", "2024-06-11", 10, 1))
    rows = {r["relative_day"]: r for r in
            dicts(event_day_metrics(events(spark, ("A", "2024-06-10")), b))}
    assert rows[0]["daily_return"] is None and rows[1]["daily_return"] == 1


def test_event_without_bars(spark):
    rows = dicts(event_day_metrics(events(spark, ("A", "2024-06-10")), bars(spark)))
    assert len(rows) == 11 and all(r["close"] is None and r["volume_ratio"] is None for r in rows)


def test_cohort_rules(spark):
    schema = "relative_day int, cap_bucket string, close decimal(12,4), " \
             "daily_return decimal(30,17), volume_ratio double"
    rows = [(0, "MID", dec(1), dec(x), 1.0) for x in ("0.01", "0.02", "0.03", "0.04")]
    rows += [(0, "MID", dec(1), None, None), (0, "MID", None, dec("9"), 9.0),
             (None, "MID", dec(1), dec("9"), 9.0), (-5, "MID", dec(1), None, 2.0)]
    got = {r["relative_day"]: r for r in dicts(cohort_metrics(spark.createDataFrame(rows, schema)))}
    zero = got[0]
    assert zero["event_count"] == 5
    assert zero["avg_return"] == Decimal("0.025000")
    assert zero["median_return"] == Decimal("0.020000")   # lower of the two middle elements
    assert zero["positive_rate"] == Decimal("0.8000")     # a missing return is not positive
    assert zero["avg_volume_ratio"] == Decimal("1.0000")
    first = got[-5]
    assert first["avg_return"] is None and first["median_return"] is None
    assert first["positive_rate"] == 0
    assert set(got) == {0, -5}


def test_cohort_dimensions_are_an_argument(spark):
    b = bars(spark, ("A", "2024-06-10", 5, 1), ("A", "2024-06-11", 10, 1))
    days = event_day_metrics(events(spark, ("A", "2024-06-10")), b)
    got = cohort_metrics(days, ["relative_day", "fiscal_quarter"])
    assert got.columns[:3] == ["relative_day", "fiscal_quarter", "event_count"]
    assert got.count() == 2


def _joined_summary(days):
    """The summary as three filtered tables joined."""
    ret, rel = F.col("daily_return"), F.col("relative_day")
    pre = days.filter(rel.between(-5, -1)).groupBy(
        "ticker", "event_id", "event_date", "fiscal_quarter", "cap_bucket").agg(
        F.sum(ret).cast(RETURN).alias("pre_return"),
        F.avg("volume_ratio").cast(RATIO).alias("avg_pre_volume_ratio"))
    zero = days.filter(rel == 0).select(
        "ticker", "event_id", ret.cast(RETURN).alias("day0_return"),
        F.col("close").cast(PRICE).alias("event_close"))
    post = days.filter(rel.between(1, 5)).groupBy("ticker", "event_id").agg(
        F.sum(ret).cast(RETURN).alias("post_return"),
        F.avg("volume_ratio").cast(RATIO).alias("avg_post_volume_ratio"))
    return pre.join(zero, ["ticker", "event_id"], "left").join(post, ["ticker", "event_id"], "left")


def test_one_pass_summary_equals_three_joined_tables(spark, sf_dir):
    from eventide.sources import tables
    study = tables.TABLE_STUDY
    days = event_day_metrics(tables.announcements(spark, sf_dir), tables.bars(spark, sf_dir), study)
    one, three = event_summary(days), _joined_summary(days)
    three = three.select(*one.columns)
    assert one.count() > 100
    assert one.exceptAll(three).isEmpty() and three.exceptAll(one).isEmpty()


def test_summary_of_an_event_on_the_last_day(spark):
    end = d("2024-06-11")
    b = bars(spark, ("A", "2024-06-10", 10, 1), ("A", "2024-06-11", 11, 1), ("A", "2024-06-12", 99, 1))
    days = event_day_metrics(events(spark, ("A", "2024-06-11")), b, StudyConfig(end=end))
    (row,) = dicts(event_summary(days))
    assert row["pre_return"] is None                     # one bar, no return: a null sum
    assert row["day0_return"] == Decimal("0.100000") and row["event_close"] == Decimal("11.0000")
    assert row["post_return"] is None and row["avg_post_volume_ratio"] is None


def test_summary_is_driven_by_the_days_before(spark):
    ev, b = events(spark, ("A", "2024-06-11")), bars(spark, ("A", "2024-06-11", 11, 1))
    days = event_day_metrics(ev, b)
    assert event_summary(days.filter(F.col("relative_day") >= 0)).isEmpty()


def test_a_return_too_wide_for_its_column_is_null(spark):
    b = bars(spark, ("A", "2024-06-10", "0.0001", 1), ("A", "2024-06-11", "99999999", 1))
    (row,) = dicts(event_summary(event_day_metrics(events(spark, ("A", "2024-06-11")), b)))
    assert row["day0_return"] is None and row["event_close"] == Decimal("99999999.0000")


def test_invariants(spark, sf_dir):
    from eventide.sources import tables
    study = tables.TABLE_STUDY
    days = event_day_metrics(
        tables.announcements(spark, sf_dir), tables.bars(spark, sf_dir), study).cache()
    per_event = days.groupBy("event_id").agg(
        F.count("*").alias("n"), F.sum("daily_return").alias("total"),
        F.max_by("cum_return", "day").alias("last"))
    assert per_event.filter((F.col("n") > 11) | ~F.col("total").eqNullSafe(F.col("last"))).isEmpty()
    assert days.filter(~F.col("relative_day").between(-5, 5)).isEmpty()
    counted = cohort_metrics(days).agg(F.sum("event_count")).first()[0]
    assert counted == days.filter(F.col("close").isNotNull()).count()
    days.unpersist()
