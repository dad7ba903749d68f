"""What a run read and wrote."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.config import StudyConfig

MANIFEST = T.StructType([
    T.StructField("run_ts", T.TimestampType()),
    T.StructField("tickers", T.ArrayType(T.StringType())),
    T.StructField("analysis_start", T.DateType()),
    T.StructField("analysis_end", T.DateType()),
    T.StructField("row_counts", T.MapType(T.StringType(), T.LongType())),
])


def manifest_row(spark: SparkSession, run_ts: datetime, tickers: Sequence[str] | DataFrame | None,
                 config: StudyConfig, counts: Mapping[str, int]) -> DataFrame:
    """One row for the run, and one per ticker where they came as a table.

    A list of tickers is in the run's own row; a table, which may be long, is not gathered into one
    row but follows in rows of its own. No list at all means every landed ticker.
    """
    table = tickers if isinstance(tickers, DataFrame) else None
    named = [] if table is not None or tickers is None else list(tickers)
    run = spark.createDataFrame([(run_ts, named, config.start, config.end, dict(counts))], MANIFEST)
    if table is None:
        return run
    each = table.select("ticker").distinct().select(
        F.lit(run_ts).alias("run_ts"), F.array("ticker").alias("tickers"),
        F.lit(config.start).alias("analysis_start"), F.lit(config.end).alias("analysis_end"),
        F.lit(None).cast("map<string,bigint>").alias("row_counts"))
    return run.unionByName(each)


def append_manifest(manifest: DataFrame, path: str) -> None:
    """JSON lines of a run, beside those of earlier runs."""
    manifest.write.mode("append").json(path)


def run_counts(config: StudyConfig, **tables: DataFrame) -> DataFrame:
    """The manifest figures of tables not being written: one row per table."""
    parts = [
        df.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_distinct("ticker").alias("ticker_count"),
        ).select(
            F.lit(name).alias("table_name"),
            F.lit(config.start.isoformat()).alias("analysis_start"),
            F.lit(config.end.isoformat()).alias("analysis_end"),
            "ticker_count",
            "row_count",
        )
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
