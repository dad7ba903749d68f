"""Trades and sessions.

A session of a ticker ends where the gap to the next trade exceeds the limit or the local date
changes. Gaps count whole seconds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.config import EXCHANGE_TZ, SESSION_GAP_MINUTES
from eventide.functions import wall_clock

# Trade time of each price of a daily bar.
BAR_TRADES = (("open", 9, 30), ("high", 11, 0), ("low", 14, 0), ("close", 16, 0))

# One minute: local dates change on whole minutes, also where clocks are turned back at midnight.
WIDEST_SLICE = 60
# Over so many slots trades without a time are numbered.
_UNTIMED_SLOTS = 1 << 16
_DAY_SECONDS = 86_400

_DAY = ["_ticker", "_day"]
_SLICE = [*_DAY, "_slot", "local_date"]
_DERIVED = ("local_ts", "local_date", "prev_trade_ts", "gap_minutes", "is_session_start",
            "session_index", "session_id")


def bar_sessions(bars: DataFrame, gap_minutes: float = SESSION_GAP_MINUTES,
                 tz: str = EXCHANGE_TZ) -> DataFrame:
    """Sessions of the trades of daily bars, one bar per ticker and day, as cleaning leaves them.

    A bar's four trades are in order, so all that is needed of a day lies in its row. Bars, not
    trades, are shuffled, once, and ordered per ticker: one row a day. Trades of bars without a date
    come first, each a session of its own.
    """
    undated = F.col("trade_date").isNull()

    def local(trade: Column) -> Column:
        return F.to_date(F.from_utc_timestamp(trade["trade_ts"], tz))

    def opens(trade: Column, before: Column) -> Column:
        gap = (F.unix_timestamp(trade["trade_ts"]) - F.unix_timestamp(before["trade_ts"])) / F.lit(60.0)
        return (before["trade_ts"].isNull() | (gap > gap_minutes) | (local(trade) != local(before))).cast("int")

    # How many trades up to each start a session, the first of the day apart.
    starts = F.transform("_trades", lambda t, i: F.when(i == 0, 0).when(undated, 1).otherwise(
        opens(t, F.get("_trades", i - 1))))
    traded = (
        bars.select("ticker", "trade_date", "cap_bucket",
                    F.filter(_trades_of_bar(), lambda t: t["price"].isNotNull()).alias("_trades"))
        .filter(F.size("_trades") > 0)
        .withColumn("_starts", starts)
        .withColumns({
            "_ticker": _ticker_key(), "_inner": F.aggregate("_starts", F.lit(0), lambda a, x: a + x),
            "_first": F.get("_trades", F.lit(0)), "_last": F.element_at("_trades", -1)})
    )
    in_order = Window.partitionBy("_ticker").orderBy("trade_date")
    linked = traded.withColumn("_day_prev", F.lag("_last").over(in_order))
    opened = linked.withColumn("_opens", F.when(undated | F.col("_day_prev").isNull(), 1).otherwise(
        opens(F.col("_first"), F.col("_day_prev"))))
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("_inner") + F.col("_opens")).over(earlier), F.lit(0))
    counted = opened.withColumn("_before", before).select(
        "ticker", "trade_date", "cap_bucket", "_trades", "_starts", F.col("_day_prev.trade_ts").alias("_day_prev"),
        "_opens", "_before", F.posexplode("_trades").alias("_i", "_trade"))
    placed = counted.select(
        "ticker", "trade_date", "_trade.*", "cap_bucket", "_day_prev", "_opens", "_before",
        F.get("_trades", F.col("_i") - 1)["trade_ts"].alias("_prev"),
        F.get("_starts", "_i").alias("_starts"), (F.col("_i") == 0).alias("_leads_day"),
        F.aggregate(F.slice("_starts", F.lit(1), F.col("_i") + 1), F.lit(0), lambda a, x: a + x).alias("_so_far"))
    localised = placed.withColumn("local_ts", F.from_utc_timestamp("trade_ts", tz)).withColumn(
        "local_date", F.to_date("local_ts"))
    return _numbered(localised, ["ticker", "trade_date", "trade_ts", "price", "trade_type", "cap_bucket"],
                     F.col("_leads_day"))


def _trades_of_bar() -> Column:
    return F.array(*[
        F.struct(
            wall_clock(F.col("trade_date"), hour, minute).alias("trade_ts"),
            F.col(kind).alias("price"),
            F.lit(kind).alias("trade_type"),
        )
        for kind, hour, minute in BAR_TRADES
    ])


def bar_trades(bars: DataFrame) -> DataFrame:
    """Four timed trades per daily bar, from one scan; a price that is null gives no trade."""
    return (
        bars.select("ticker", "trade_date", "cap_bucket", F.inline(_trades_of_bar()))
        .filter(F.col("price").isNotNull())
        .select("ticker", "trade_date", "trade_ts", "price", "trade_type", "cap_bucket")
    )


def _seconds_between(later: str, earlier: str) -> Column:
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def session_id(ticker: Column, index: Column) -> Column:
    """``TICKER#000001``; an index of more than six digits is kept whole."""
    text = index.cast("string")
    return F.concat(ticker, F.lit("#"), F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0")))


def slice_seconds_for(gap_minutes: float, widest: int = WIDEST_SLICE) -> int:
    """Widest slice, in seconds, inside which no gap can exceed the limit."""
    return min(widest, math.floor(gap_minutes * 60) + 1)


def _ticker_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), "ticker"), F.lit(""))


def _keyed(trades: DataFrame, tz: str, width: int) -> DataFrame:
    """Add local time, and the slice and UTC day a trade falls in; keys are never null."""
    slot = F.floor(F.unix_timestamp("trade_ts") / width)
    return trades.withColumn("local_ts", F.from_utc_timestamp("trade_ts", tz)).withColumns({
        "local_date": F.to_date("local_ts"),
        "_ticker": _ticker_key(),
        "_slot": slot,
        "_day": F.floor(slot * width / _DAY_SECONDS),
    })


def _opens(at: str, date: str, before: str, date_before: str, gap_minutes: float) -> Column:
    """Whether a session starts, as 0 or 1, given the trade before."""
    gap = _seconds_between(at, before) / F.lit(60.0) > F.lit(gap_minutes)
    return (F.col(before).isNull() | gap | (F.col(date) != F.col(date_before))).cast("int")


def _days(slices: DataFrame, gap_minutes: float, trades: DataFrame) -> DataFrame:
    """Per ticker and day what came before it: last trade, sessions, and whether it starts one.

    The only rows that are ordered per ticker, at most one a day. Trades without a time come first.
    """
    untimed = trades.filter(F.col("trade_ts").isNull()).groupBy(_ticker_key().alias("_ticker")).agg(
        F.count("*").alias("_untimed"))
    at = F.struct("_first", "_date")
    days = slices.groupBy(*_DAY).agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_starts").alias("_inner"),
        F.min_by("_date", at).alias("_first_date"), F.max_by("_date", at).alias("_last_date"))
    in_order = Window.partitionBy("_ticker").orderBy("_day")
    linked = days.withColumns({
        "_day_prev": F.lag("_last").over(in_order), "_day_prev_date": F.lag("_last_date").over(in_order)})
    opened = linked.withColumn(
        "_opens", _opens("_first", "_first_date", "_day_prev", "_day_prev_date", gap_minutes))
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("_inner") + F.col("_opens")).over(earlier), F.lit(0))
    numbered = opened.withColumn("_before", before).join(untimed, "_ticker", "left")
    return numbered.select(*_DAY, "_day_prev", "_opens",
                           (F.col("_before") + F.coalesce("_untimed", F.lit(0))).alias("_before"))


def _numbered(placed: DataFrame, columns: Sequence[str], first: Column) -> DataFrame:
    """Finish trades that know their day, the trade before, and the starts in their day so far.

    ``first`` tells the first trade of each day.
    """
    return (
        placed
        .withColumn("prev_trade_ts", F.when(first, F.col("_day_prev")).otherwise(F.col("_prev")))
        .withColumns({
            "gap_minutes": _seconds_between("trade_ts", "prev_trade_ts") / F.lit(60.0),
            "is_session_start": F.when(first, F.col("_opens")).otherwise(F.col("_starts")).cast("int"),
            "session_index": F.col("_before") + F.col("_opens") + F.col("_so_far"),
        })
        .withColumn("session_id", session_id(F.col("ticker"), F.col("session_index")))
        .select(*columns, *_DERIVED)
    )


def _untimed(trades: DataFrame, tie_break: Sequence[str], tz: str) -> DataFrame:
    """Trades without a time, each a session of its own, numbered in slots spread by their columns."""
    spread = F.pmod(F.xxhash64(*tie_break), F.lit(_UNTIMED_SLOTS)) if tie_break else F.lit(0)
    keyed = _keyed(trades.filter(F.col("trade_ts").isNull()), tz, _DAY_SECONDS).withColumn("_slot", spread)
    slots = keyed.groupBy("_ticker", "_slot").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_ticker").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.select("_ticker", "_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    order = [F.col(c) for c in tie_break] or [F.lit(0)]
    rank = F.row_number().over(Window.partitionBy("_ticker", "_slot").orderBy(*order))
    placed = keyed.withColumn("_rank", rank).join(offsets, ["_ticker", "_slot"])
    return placed.withColumns({
        "prev_trade_ts": F.lit(None).cast("timestamp"), "gap_minutes": F.lit(None).cast("double"),
        "is_session_start": F.lit(1), "session_index": F.col("_offset") + F.col("_rank"),
    }).withColumn("session_id", session_id(F.col("ticker"), F.col("session_index"))).select(
        *trades.columns, *_DERIVED)


def sessionize(
    trades: DataFrame,
    gap_minutes: float = SESSION_GAP_MINUTES,
    tz: str = EXCHANGE_TZ,
    tie_break: Sequence[str] | None = None,
    widest_slice: int = WIDEST_SLICE,
) -> DataFrame:
    """Add local time, previous trade, gap and session to each trade of (ticker, trade_ts, ...).

    Trades of one instant are ordered by ``tie_break`` (by default all other columns that have an
    order); trades without a time come first, each a session of its own, in a fixed order.

    A running sum per ticker would put a busy ticker into one task. Instead time is cut into slices
    no longer than the gap limit: inside one no session can start except at its first trade, and
    every trade but the first of its instant follows one of the same instant. So instants are
    combined before their shuffle, and carried to slices, from slices to days, and over days: only
    one row per day is ordered per ticker. Of an instant's trades only those that lead it, equal in
    all of ``tie_break``, meet in one task; other columns are neither grouped nor compared.
    """
    if tie_break is None:
        tie_break = [f.name for f in trades.schema if f.name not in ("ticker", "trade_ts")
                     and not isinstance(f.dataType, T.MapType | T.VariantType)]
    width = slice_seconds_for(gap_minutes, widest_slice)
    keyed = _keyed(trades.filter(F.col("trade_ts").isNotNull()), tz, width)
    lead = F.struct(*tie_break) if tie_break else F.struct(F.lit(0).alias("_none"))
    keyed = keyed.withColumn("_tie", lead)
    narrow = keyed.select(*_SLICE, "trade_ts", "_tie")

    instants = narrow.groupBy(*_SLICE, "trade_ts").agg(F.min("_tie").alias("_tie"))
    in_slice = Window.partitionBy(*_SLICE).orderBy("trade_ts")
    linked = instants.withColumn("_instant_prev", F.lag("trade_ts").over(in_slice))

    slices = linked.groupBy(*_SLICE).agg(F.min("trade_ts").alias("_first"), F.max("trade_ts").alias("_last"))
    in_day = Window.partitionBy(*_DAY).orderBy("_slot", "local_date")
    slices = slices.withColumns({
        "_slice_prev": F.lag("_last").over(in_day), "_prev_date": F.lag("local_date").over(in_day),
        "_date": F.col("local_date")})
    slices = slices.withColumn("_starts", F.when(F.col("_slice_prev").isNull(), 0).otherwise(
        _opens("_first", "local_date", "_slice_prev", "_prev_date", gap_minutes)))
    so_far = in_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn("_so_far", F.sum("_starts").over(so_far))
    carried = slices.join(_days(slices, gap_minutes, trades), _DAY).select(
        *_SLICE, "_first", "_slice_prev", "_starts", "_so_far", "_day_prev", "_opens", "_before")

    # Leaders of their instants, and how many rows are equal to them.
    leaders = linked.withColumnRenamed("_tie", "_lead_tie").select(
        *[F.col(c).alias(f"_of{c}") for c in _SLICE], F.col("trade_ts").alias("_of_ts"), "_lead_tie",
        "_instant_prev")
    same = [F.col(c) == F.col(f"_of{c}") for c in _SLICE] + [
        F.col("trade_ts") == F.col("_of_ts"), F.col("_tie").eqNullSafe(F.col("_lead_tie"))]
    copies = Window.partitionBy(*_SLICE, "trade_ts", "_tie").orderBy("_leads")
    ranked = (
        keyed.join(leaders, same, "left")
        .withColumn("_leads", F.col("_of_ts").isNotNull())
        .withColumn("_leads", F.col("_leads") & (F.row_number().over(copies) == 1))
    )
    # The first trade of a slice follows the slice before; others follow in their own slice.
    first = F.col("_leads") & (F.col("trade_ts") == F.col("_first"))
    own_prev = F.when(F.col("_leads"), F.col("_instant_prev")).otherwise(F.col("trade_ts"))
    placed = ranked.drop("_first").join(carried, _SLICE).withColumns({
        "_prev": F.when(first, F.col("_slice_prev")).otherwise(own_prev),
        "_starts": F.when(first, F.col("_starts")).otherwise(0),
    })
    timed = _numbered(placed, trades.columns, F.col("_prev").isNull())
    return timed.unionByName(_untimed(trades, tie_break, tz))


def session_counts(sessions: DataFrame) -> DataFrame:
    """Trades and distinct sessions of the whole table; trades without a ticker share one."""
    unnamed = F.coalesce(F.max(F.col("session_id").isNull().cast("int")), F.lit(0))
    return sessions.agg(
        F.count("*").alias("trade_count"),
        (F.count_distinct("session_id") + unnamed).alias("session_count"),
    )
