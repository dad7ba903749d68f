"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def pandas_change(current: Column, previous: Column) -> Column:
    """``current / previous - 1`` on doubles with IEEE results for a zero divisor; 0/0 is null."""
    return (
        F.when(previous != 0, current / F.nullif(previous, F.lit(0.0)) - 1)
        .when((previous == 0) & (current > 0), F.lit(float("inf")))
        .when((previous == 0) & (current < 0), F.lit(float("-inf")))
    )


def rounded(column: Column, digits: int) -> Column:
    return F.round(column.cast("double"), digits)
