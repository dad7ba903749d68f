"""Column expressions: all native, so they stay inside generated code."""

from eventide.functions.buckets import cap_bucket, register_cap_bucket
from eventide.functions.dates import (
    event_key,
    exchange_date,
    quarter_label,
    wall_clock,
    whole_days,
)
from eventide.functions.numbers import nan_to_null, pandas_change, rounded
from eventide.schemas import finite_or_null

__all__ = [
    "cap_bucket", "register_cap_bucket", "event_key", "exchange_date", "quarter_label",
    "wall_clock", "whole_days", "nan_to_null", "pandas_change", "rounded", "finite_or_null",
]
