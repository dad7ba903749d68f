"""Study parameters. Every operator takes what it needs as arguments; this holds the defaults."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# Defaults and ticker sets that results depend on.
ANALYSIS_START = date(2018, 1, 1)
ANALYSIS_END = date(2024, 12, 31)
DAYS_BEFORE = 5
DAYS_AFTER = 5
SESSION_GAP_MINUTES = 25
EXCHANGE_TZ = "America/New_York"
NEAREST_SPAN_DAYS = 14
MIN_BARS = 3
TICKER_CHIPS = 12
LARGE_CAP = (
    "AAPL", "MSFT", "GOOGL", "AMZN", "NVDA", "META", "TSLA",
    "JPM", "BAC", "GS", "MS", "JNJ", "XOM", "CVX", "WMT",
)
MID_CAP = ("PFE", "ABBV", "COST", "TGT", "BA", "CAT", "GE")
STUDY_TICKERS = LARGE_CAP + MID_CAP


@dataclass(frozen=True)
class StudyConfig:
    """One study: date range, window size, session rule, ticker sets."""

    start: date = ANALYSIS_START
    end: date = ANALYSIS_END
    days_before: int = DAYS_BEFORE
    days_after: int = DAYS_AFTER
    session_gap_minutes: float = SESSION_GAP_MINUTES
    exchange_tz: str = EXCHANGE_TZ
    nearest_span_days: int = NEAREST_SPAN_DAYS
    min_bars: int = MIN_BARS
    large_cap: tuple[str, ...] = LARGE_CAP
    mid_cap: tuple[str, ...] = MID_CAP
