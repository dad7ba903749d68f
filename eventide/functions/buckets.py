"""Ticker → market-cap bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from eventide.config import LARGE_CAP, MID_CAP

# Fixed value: Unicode white space plus the four ASCII separators, at either end.
_OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def cap_bucket(
    ticker: Column | str,
    large: Sequence[str] = LARGE_CAP,
    mid: Sequence[str] = MID_CAP,
    blank_as_other: bool = True,
    strip: bool = True,
) -> Column:
    """LARGE, MID, SMALL, or OTHER for a null or blank ticker.

    ``strip=False, blank_as_other=False`` is the variant of the on-demand study: no trimming and
    no OTHER.
    """
    raw = F.col(ticker) if isinstance(ticker, str) else ticker
    text = F.regexp_replace(raw, _OUTER_SPACE, "") if strip else raw
    symbol = F.upper(text)
    bucket = (
        F.when(symbol.isin(*large), "LARGE").when(symbol.isin(*mid), "MID").otherwise("SMALL")
    )
    if not blank_as_other:
        return bucket
    return F.when(raw.isNull() | (text == ""), "OTHER").otherwise(bucket)


def register_cap_bucket(
    spark: SparkSession,
    name: str = "cap_bucket",
    large: Sequence[str] = LARGE_CAP,
    mid: Sequence[str] = MID_CAP,
) -> None:
    """Make the classifier callable from SQL as a temporary SQL function, inlined by Catalyst."""
    def quoted(values: Sequence[str]) -> str:
        return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)

    pattern = _OUTER_SPACE.replace("\\", "\\\\")
    text = f"regexp_replace(ticker, '{pattern}', '')"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(ticker STRING) RETURNS STRING
        RETURN CASE
            WHEN ticker IS NULL OR {text} = '' THEN 'OTHER'
            WHEN upper({text}) IN ({quoted(large)}) THEN 'LARGE'
            WHEN upper({text}) IN ({quoted(mid)}) THEN 'MID'
            ELSE 'SMALL' END
    """)
