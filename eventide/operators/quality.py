"""Data-quality figures, of tables and of writes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_report(df: DataFrame, table_name: str) -> DataFrame:
    """(table_name, column_name, null_count, total_rows) per column, from one pass."""
    columns = df.columns
    counted = df.agg(
        F.count("*").alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    return counted.select(F.lit(table_name).alias("table_name"), "total_rows", *columns).unpivot(
        ["table_name", "total_rows"], columns, "column_name", "null_count"
    ).select("table_name", "column_name", "null_count", "total_rows")


def column_figures(schema: T.StructType) -> dict[str, Column]:
    """Aggregates to observe in a write: nulls of each column, least and greatest number or day.

    Days are counted from 1970-01-01. Names are ``measure:column``.
    """
    found = {}
    for column in schema:
        value = F.col(f"`{column.name.replace('`', '``')}`")
        found[f"nulls:{column.name}"] = F.count_if(value.isNull())
        if isinstance(column.dataType, T.DateType):
            value = F.unix_date(value)
        elif not isinstance(column.dataType, T.NumericType):
            continue
        found[f"least:{column.name}"] = F.min(value).cast("double")
        found[f"greatest:{column.name}"] = F.max(value).cast("double")
    return found


@dataclass(frozen=True)
class Gates:
    """What a write has to hold to be published; by default anything is.

    ``null_share``: the largest share of nulls by column. ``ranges``: least and greatest value by
    column, None for an open end; days count from 1970-01-01. ``rejected_share``: of raw rows that
    cleaning will leave out. ``rows_of_last``: rows as a share of those of the last published write of
    the same kind, at least. A write without rows has no shares, and only ``rows_of_last`` can fail it.
    """

    null_share: Mapping[str, float] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    rejected_share: float | None = None
    rows_of_last: float | None = None

    def failures(self, figures: Mapping[str, float | None], last_rows: float | None = None) -> list[str]:
        """What the figures of a write fail, in words."""
        rows = figures["rows"]
        found = []
        for column, most in self.null_share.items():
            nulls = figures[f"nulls:{column}"]
            if nulls > most * rows:
                found.append(f"{nulls} of {rows} rows have no {column}")
        for column, (low, high) in self.ranges.items():
            least, greatest = figures[f"least:{column}"], figures[f"greatest:{column}"]
            if low is not None and least is not None and least < low:
                found.append(f"{column} {least} is below {low}")
            if high is not None and greatest is not None and greatest > high:
                found.append(f"{column} {greatest} is above {high}")
        rejected = figures.get("rejected:*")
        if self.rejected_share is not None and rejected is not None and rejected > self.rejected_share * rows:
            found.append(f"{rejected} of {rows} rows are unusable")
        if self.rows_of_last is not None and last_rows is not None and rows < self.rows_of_last * last_rows:
            found.append(f"{rows} rows after {last_rows:.0f}")
        return found


def with_last(figures: DataFrame) -> DataFrame:
    """Stored figures beside those of the last published write of the same table and kind.

    A window holds one figure of all writes of one table: it grows with runs, not with rows.
    """
    before = Window.partitionBy("table_name", "written", "column_name", "measure").orderBy(
        "version", F.col("failed").isNull(), "value").rowsBetween(Window.unboundedPreceding, -1)
    published = F.when(F.col("failed").isNull(), F.struct("value"))
    return figures.withColumn("last_value", F.last(published, ignorenulls=True).over(before)["value"])
