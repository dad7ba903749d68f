"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_MICROS = 86_400_000_000


def event_key(ticker: Column, day: Column) -> Column:
    """``TICKER_yyyyMMdd``."""
    return F.concat_ws("_", ticker, F.date_format(day, "yyyyMMdd"))


def quarter_label(day: Column) -> Column:
    """Calendar quarter as ``Q1``..``Q4``."""
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"))


def exchange_date(day: Column, tz: str, dates_are_local: bool = False) -> Column:
    """Calendar date at the exchange.

    By default the midnight of ``day`` is read as UTC and shifted, which for New York gives the day
    before. ``dates_are_local=True`` takes the date as already local.
    """
    if dates_are_local:
        return day
    return F.to_date(F.from_utc_timestamp(day.cast("timestamp_ntz").cast("timestamp"), tz))


def wall_clock(day: Column, hours: int, minutes: int) -> Column:
    """Timestamp at a time of day, by wall clock whatever the session time zone does that day."""
    offset = F.make_dt_interval(hours=F.lit(hours), mins=F.lit(minutes))
    return (day.cast("timestamp_ntz") + offset).cast("timestamp")


def whole_days(later: Column, earlier: Column) -> Column:
    """Days from ``earlier`` to ``later``, rounded down: minus eight hours is minus one day."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(_DAY_MICROS))
