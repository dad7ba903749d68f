"""Landed vendor files → raw bars and raw announcements.

Prices are expected as the vendor adjusts them for splits and dividends; nothing here adjusts them.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from eventide.functions import event_key, nan_to_null
from eventide.schemas import LANDED, LANDED_BARS, RAW_ANNOUNCEMENTS, RAW_BARS

CORRUPT = "_corrupt_record"
_TEXT_FORMATS = ("csv", "json")


Reader = DataFrameReader | DataStreamReader


def _read(reader: Reader, path: str | list[str], fmt: str, schema: T.StructType,
          options: dict[str, str]) -> DataFrame:
    reader = reader.format(fmt)
    if fmt in _TEXT_FORMATS:
        schema = T.StructType([*schema, T.StructField(CORRUPT, T.StringType())])
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        if fmt == "csv":
            reader = reader.option("header", "true")
    frame = reader.options(**options).schema(schema).load(path)
    frame = frame.withColumn(LANDED.name, F.col("_metadata.file_modification_time"))
    if fmt not in _TEXT_FORMATS:
        return frame.withColumn(CORRUPT, F.lit(None).cast("string"))
    # Only columns a query needs are parsed, so a bad value elsewhere would let its row through and
    # one file would give different rows to different queries. Tying the record to a hash of all
    # columns makes every query parse all of them.
    parsed = F.xxhash64(*[f.name for f in schema if f.name != CORRUPT]).cast("string")
    return frame.withColumn(
        CORRUPT, F.substring_index(F.concat(F.col(CORRUPT), F.lit("\x00"), parsed), "\x00", 1))


def usable_bars(reader: Reader, path: str | list[str], fmt: str = "parquet",
                **options: str) -> DataFrame:
    """Raw daily bars from a batch or stream reader.

    NaN prices become null; rows that do not parse are left out (see `rejected`). ``landed_at`` is
    the time of the row's file.
    """
    frame = _read(reader, path, fmt, RAW_BARS, options).filter(F.col(CORRUPT).isNull())
    return frame.select(*[
        nan_to_null(F.col(f.name)).alias(f.name) if f.dataType == T.DoubleType() else F.col(f.name)
        for f in LANDED_BARS
    ])


def usable_announcements(reader: Reader, path: str | list[str], fmt: str = "parquet",
                         **options: str) -> DataFrame:
    """Raw announcement dates; a missing ``event_id`` is built from ticker and date."""
    frame = _read(reader, path, fmt, RAW_ANNOUNCEMENTS, options).filter(F.col(CORRUPT).isNull())
    built = event_key(F.col("ticker"), F.col("event_date").try_cast("date"))
    return frame.select("ticker", "event_date", F.coalesce("event_id", built).alias("event_id"), LANDED.name)


def read_bars(spark: SparkSession, path: str | list[str], fmt: str = "parquet",
              **options: str) -> DataFrame:
    return usable_bars(spark.read, path, fmt, **options)


def read_announcements(spark: SparkSession, path: str | list[str], fmt: str = "parquet",
                       **options: str) -> DataFrame:
    return usable_announcements(spark.read, path, fmt, **options)


def rejected(spark: SparkSession, path: str | list[str], fmt: str, schema: T.StructType,
             **options: str) -> DataFrame:
    """The rows the readers above leave out, with their raw text."""
    return _read(spark.read, path, fmt, schema, options).filter(F.col(CORRUPT).isNotNull())


def in_range(df: DataFrame, column: str, start: date, end: date,
             include_end: bool = True) -> DataFrame:
    """Rows whose date, text or typed, lies in the range."""
    text = isinstance(df.schema[column].dataType, T.StringType)
    low, high = (F.lit(d.isoformat() if text else d) for d in (start, end))
    value = F.col(column)
    return df.filter((value >= low) & ((value <= high) if include_end else (value < high)))


def only_tickers(df: DataFrame, tickers: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the given tickers: a list becomes a pushed-down filter, a table a semi join."""
    if isinstance(tickers, DataFrame):
        return df.join(tickers.select("ticker"), "ticker", "left_semi")
    return df.filter(F.col("ticker").isin(*tickers))
