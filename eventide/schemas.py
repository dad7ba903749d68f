"""Declared schemas of every table and served row shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE = T.DecimalType(12, 4)
RETURN = T.DecimalType(10, 6)
RATIO = T.DecimalType(10, 4)
RATE = T.DecimalType(6, 4)

_S, _D, _TS = T.StringType(), T.DateType(), T.TimestampType()
_L, _I, _F = T.LongType(), T.IntegerType(), T.DoubleType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Bronze: as landed.
RAW_BARS = _table(ticker=_S, trade_date=_S, open=_F, high=_F, low=_F, close=_F, volume=_L)
RAW_ANNOUNCEMENTS = _table(ticker=_S, event_date=_S, event_id=_S)

# Bronze as stored: with the time a row arrived, by which a correction beats what it corrects.
LANDED = T.StructField("landed_at", _TS)
LANDED_BARS = T.StructType([*RAW_BARS, LANDED])
LANDED_ANNOUNCEMENTS = T.StructType([*RAW_ANNOUNCEMENTS, LANDED])

# Silver: typed, one row per key.
BARS = _table(ticker=_S, trade_date=_D, open=PRICE, high=PRICE, low=PRICE, close=PRICE,
              volume=_L, cap_bucket=_S, local_date=_D)
ANNOUNCEMENTS = _table(ticker=_S, event_date=_D, event_id=_S, cap_bucket=_S, fiscal_quarter=_S)

# Silver as stored: a row remembers when it arrived, so that later ones can be merged into it.
STORED_BARS = T.StructType([*BARS, LANDED])
STORED_ANNOUNCEMENTS = T.StructType([*ANNOUNCEMENTS, LANDED])

# Gold. Day-level returns keep the width decimal division gives; only aggregates narrow them.
EVENT_DAY_METRICS = _table(
    event_id=_S, ticker=_S, event_date=_D, fiscal_quarter=_S, cap_bucket=_S, day=_D,
    relative_day=_I, trade_date=_D, open=PRICE, high=PRICE, low=PRICE, close=PRICE, volume=_L,
    daily_return=T.DecimalType(30, 17), cum_return=T.DecimalType(38, 17), volume_ratio=_F,
)
TRADE_SESSIONS = _table(
    ticker=_S, trade_date=_D, trade_ts=_TS, price=PRICE, trade_type=_S, cap_bucket=_S,
    local_ts=_TS, local_date=_D, prev_trade_ts=_TS, gap_minutes=_F, is_session_start=_I,
    session_index=_L, session_id=_S,
)
COHORTS = _table(
    relative_day=_I, cap_bucket=_S, event_count=_L, avg_return=RETURN, median_return=RETURN,
    avg_volume_ratio=RATIO, positive_rate=RATE,
)
COHORT_STATE = _table(
    ticker=_S, relative_day=_I, cap_bucket=_S, days=_L, returns=_L, return_sum=T.DecimalType(38, 17), rising=_L,
    ratios=_L, ratio_sum=_F, sketch=T.BinaryType(),
)
# Figures of a write: of a column, or of all rows for the column ``*``. What ``failed`` says kept it unpublished.
QUALITY = _table(table_name=_S, version=_L, written=_S, column_name=_S, measure=_S, value=_F, failed=_S)
EVENT_SUMMARY = _table(
    ticker=_S, event_id=_S, event_date=_D, fiscal_quarter=_S, cap_bucket=_S, pre_return=RETURN,
    avg_pre_volume_ratio=RATIO, day0_return=RETURN, event_close=PRICE, post_return=RETURN,
    avg_post_volume_ratio=RATIO,
)

# Served rows. Dates are yyyy-MM-dd text; measures are doubles so that precomputed decimals and
# on-demand doubles share one shape.
TICKER_ROW = _table(ticker=_S, cap_bucket=_S, event_count=_L)
EVENT_ROW = _table(
    ticker=_S, event_id=_S, event_date=_S, fiscal_quarter=_S, cap_bucket=_S, pre_return=_F,
    day0_return=_F, post_return=_F, event_close=_F, avg_pre_volume_ratio=_F,
    avg_post_volume_ratio=_F,
)
TICKER_EVENT_ROW = T.StructType([
    *EVENT_ROW, T.StructField("event_count", _L), T.StructField("ticker_cap_bucket", _S),
])
WINDOW_ROW = _table(
    ticker=_S, event_id=_S, event_date=_S, relative_day=_I, daily_return=_F, cum_return=_F,
    volume_ratio=_F, close=_F,
)
COHORT_ROW = _table(
    relative_day=_I, cap_bucket=_S, event_count=_L, avg_return=_F, median_return=_F,
    avg_volume_ratio=_F, positive_rate=_F,
)


def finite_or_null(column: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select exactly the columns of ``schema``; a value that does not fit its type becomes null."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


def served(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``conform`` for a served shape: doubles are finite or null."""
    shaped = conform(df, schema)
    return shaped.select(*[
        finite_or_null(F.col(f.name)).alias(f.name) if f.dataType == _F else F.col(f.name)
        for f in schema
    ])
