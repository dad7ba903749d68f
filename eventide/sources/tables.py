"""The star-schema test tables seen as bars, announcements and trades (see FIXTURES.md)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.config import StudyConfig
from eventide.functions import cap_bucket, event_key, quarter_label
from eventide.schemas import PRICE

TABLE_STUDY = StudyConfig(
    start=date(1995, 1, 1),
    end=date(2001, 4, 3),
    large_cap=tuple(f"NATION_{i}" for i in range(10)),
    mid_cap=tuple(f"NATION_{i}" for i in range(10, 18)),
)

# Order of the rows of one ticker and day.
_ROW_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_ticker(rows: DataFrame, spark: SparkSession, sf_dir: str, name: str, key: str,
                 nation: str, own_key: str) -> DataFrame:
    """Add the nation's name of each row's supplier or customer.

    Joined one table at a time: each join's small side then has a size taken from its file, while
    the estimate of a join of two tables is their product.
    """
    owners = table(spark, sf_dir, name).select(F.col(key).alias(own_key), nation)
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias(nation), F.col("n_name").alias("ticker"))
    return rows.join(owners, own_key).join(nations, nation)


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ticker and trade date."""
    lines = table(spark, sf_dir, "lineitem")
    return _with_ticker(
        lines, spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "l_suppkey"
    ).withColumn("trade_date", F.to_date("l_shipdate"))


def _bar(price: Column, volume: Column) -> list[Column]:
    order = F.struct(*_ROW_ORDER)
    return [
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(volume).cast("long").alias("volume"),
    ]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver-like daily bars: one per nation and ship date."""
    return priced_lines(spark, sf_dir).groupBy("trade_date", "ticker").agg(
        *_bar(F.col("l_extendedprice").cast(PRICE), F.col("l_quantity")))


def vendor_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze-like bars that need cleaning: text dates, several rows per key, no or zero volume."""
    volume = (
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))
        .when(F.col("l_discount") < 0.02, F.lit(0.0))
    )
    return (
        priced_lines(spark, sf_dir)
        .groupBy("trade_date", "ticker", "l_returnflag")
        .agg(*_bar(F.col("l_extendedprice"), volume))
        .select("ticker", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date"),
                "open", "high", "low", "close", "volume")
    )


def _first_orders(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return (
        _with_ticker(orders, spark, sf_dir, "customer", "c_custkey", "c_nationkey", "o_custkey")
        .groupBy("ticker", F.date_trunc("quarter", "o_orderdate").alias("_quarter"), *by)
        .agg(F.to_date(F.min("o_orderdate")).alias("event_date"))
        .drop("_quarter")
    )


def vendor_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze-like announcements: first order per nation, quarter and priority, with repeats."""
    return _first_orders(spark, sf_dir, "o_orderpriority").select(
        "ticker", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
        event_key(F.col("ticker"), F.col("event_date")).alias("event_id"))


def announcements(spark: SparkSession, sf_dir: str,
                  config: StudyConfig = TABLE_STUDY) -> DataFrame:
    """Silver-like announcements: first order per nation and quarter, within the study range."""
    return _first_orders(spark, sf_dir).filter(
        F.col("event_date").between(F.lit(config.start), F.lit(config.end))
    ).select(
        "ticker", "event_date",
        event_key(F.col("ticker"), F.col("event_date")).alias("event_id"),
        cap_bucket("ticker", config.large_cap, config.mid_cap).alias("cap_bucket"),
        quarter_label(F.col("event_date")).alias("fiscal_quarter"),
    )


def timed_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First order per nation, quarter and priority at 00:00, 08:00 or 16:00, with repeats."""
    number = F.regexp_extract("ticker", r"(\d+)$", 1).cast("int")
    return _first_orders(spark, sf_dir, "o_orderpriority").select(
        "ticker",
        (F.col("event_date").cast("timestamp") + F.make_dt_interval(hours=number % 3 * 8))
        .alias("event_ts"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks: one per event of a user."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
        F.col("ts").cast("timestamp").alias("trade_ts"),
        F.col("value").cast(PRICE).alias("price"),
        F.col("event_id").alias("trade_id"),
    )
