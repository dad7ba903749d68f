"""Bronze → silver: typing, dropping unusable rows, one row per key, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.config import StudyConfig
from eventide.functions import cap_bucket, exchange_date, quarter_label
from eventide.schemas import PRICE


def latest_per_key(df: DataFrame, keys: Sequence[str], latest_by: Sequence[str] = ()) -> DataFrame:
    """One whole row per key: the greatest by ``latest_by``, then by the other columns in turn.

    The maximum of a struct combines before the shuffle, so any number of copies of one key reaches
    its reducer as at most one row per map task. A row-number window would send them all.
    The aggregate sorts by ``keys``: name the one with most distinct values first.
    """
    order = list(latest_by) + [c for c in df.columns if c not in keys and c not in latest_by]
    if not order:
        return df.dropDuplicates(list(keys))
    best = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_row"))
    return best.select(*[
        F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns
    ])


def rejected_bar() -> Column:
    """Whether `usable_bars` leaves a raw row out."""
    sold = F.coalesce(F.col("volume").try_cast("long") > 0, F.lit(False))
    return F.col("close").try_cast(PRICE).isNull() | ~sold


def usable_bars(raw: DataFrame, latest_by: Sequence[str] = ()) -> DataFrame:
    """Typed bars with a close and a positive volume; a value that does not fit its type is null."""
    typed = raw.select(
        "ticker",
        F.col("trade_date").try_cast("date").alias("trade_date"),
        *[F.col(c).try_cast(PRICE).alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").try_cast("long").alias("volume"),
        *latest_by,
    )
    return typed.filter(F.col("close").isNotNull() & (F.col("volume") > 0))


def labelled_bars(usable: DataFrame, config: StudyConfig = StudyConfig(), latest_by: Sequence[str] = (),
                  dates_are_local: bool = False) -> DataFrame:
    """One bar per (ticker, trade_date), the latest, with its labels and what made it the latest.

    Rows already chosen may be among those they are chosen from again, so that later rows can be
    merged into earlier results.
    """
    return latest_per_key(usable, ["trade_date", "ticker"], latest_by).withColumns({
        "cap_bucket": cap_bucket("ticker", config.large_cap, config.mid_cap),
        "local_date": exchange_date(F.col("trade_date"), config.exchange_tz, dates_are_local),
    })


def clean_bars(
    raw: DataFrame,
    config: StudyConfig = StudyConfig(),
    latest_by: Sequence[str] = (),
    dates_are_local: bool = False,
) -> DataFrame:
    """Typed bars with a close and a positive volume, one per (ticker, trade_date).

    A value that does not fit its type becomes null (``try_cast``), then the null rules apply.
    ``latest_by`` names the columns of ``raw`` that tell a later row from an earlier one.
    """
    return labelled_bars(usable_bars(raw, latest_by), config, latest_by, dates_are_local).drop(*latest_by)


def rejected_announcement() -> Column:
    """Whether `usable_announcements` leaves a raw row out."""
    return F.col("event_date").try_cast("date").isNull() | F.col("ticker").isNull()


def usable_announcements(raw: DataFrame, latest_by: Sequence[str] = ()) -> DataFrame:
    """Typed announcements with a date and a ticker."""
    typed = raw.select(
        "ticker", F.col("event_date").try_cast("date").alias("event_date"), "event_id", *latest_by
    )
    return typed.filter(F.col("event_date").isNotNull() & F.col("ticker").isNotNull())


def labelled_announcements(usable: DataFrame, config: StudyConfig = StudyConfig(),
                           latest_by: Sequence[str] = ()) -> DataFrame:
    """One announcement per (ticker, event_date), the latest, as `labelled_bars`."""
    return latest_per_key(usable, ["event_date", "ticker"], latest_by).withColumns({
        "cap_bucket": cap_bucket("ticker", config.large_cap, config.mid_cap),
        "fiscal_quarter": quarter_label(F.col("event_date")),
    })


def clean_announcements(
    raw: DataFrame, config: StudyConfig = StudyConfig(), latest_by: Sequence[str] = ()
) -> DataFrame:
    """Typed announcements with a date and a ticker, one per (ticker, event_date)."""
    return labelled_announcements(usable_announcements(raw, latest_by), config, latest_by).drop(*latest_by)
