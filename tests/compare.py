"""Run a registered query and its SQL and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark, con, query, sql, sf_dir):
    """(rows, only in Spark, only in SQL); raises when column names differ."""
    got = query(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names), (sorted(got.columns), sorted(names))
    left = _bag(got.columns, [tuple(r) for r in got.collect()])
    right = _bag(names, want.fetchall())
    return sum(left.values()), left - right, right - left
