"""Small hand-made frames and row helpers."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from eventide.schemas import ANNOUNCEMENTS, BARS, RAW_BARS


def from_rows(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


def d(text: str) -> date:
    return date.fromisoformat(text)


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def dec(value) -> Decimal | None:
    return None if value is None else Decimal(str(value))


def raw_bars(spark, *rows):
    """(ticker, date text, open, high, low, close, volume)"""
    return from_rows(spark, rows, RAW_BARS)


def bars(spark, *rows):
    """(ticker, day, close, volume) with all four prices equal."""
    return from_rows(
        spark,
        [(t, d(day), dec(c), dec(c), dec(c), dec(c), v, "SMALL", d(day)) for t, day, c, v in rows],
        BARS)


def events(spark, *rows):
    """(ticker, day)"""
    return from_rows(
        spark,
        [(t, d(day), f"{t}_{day.replace('-', '')}", "SMALL", "Q1") for t, day in rows],
        ANNOUNCEMENTS)


def dicts(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]
