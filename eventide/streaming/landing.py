"""Landed vendor files → bronze, each file once.

The same readers as the batch load, on Structured Streaming: a run takes the files that arrived
since the last one and stops, or keeps watching. Corrections landed later are settled by cleaning,
which keeps one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventide.sources.landed import usable_announcements, usable_bars



def stream_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return usable_bars(spark.readStream, path, fmt, **options)


def stream_announcements(spark: SparkSession, path: str, fmt: str = "parquet",
                         **options: str) -> DataFrame:
    return usable_announcements(spark.readStream, path, fmt, **options)


def checkpoint_folder(spark: SparkSession, name: str, root: str | None = None) -> str:
    """Folder of a query's progress: under the shared folder the cluster names, else under ``root``.

    Names tell queries apart, so each landed table needs its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or root
    if not root:
        raise ValueError("set spark.checkpoint.dir or pass a checkpoint root")
    return f"{root}/{name}"


def land(rows: DataFrame, path: str, name: str, checkpoint_root: str | None = None,
         every: str | None = None, writers: int = 4) -> StreamingQuery:
    """Append a stream to a bronze table by ticker, each row once even if a run is repeated.

    Rows of a ticker are brought together before they are written, a large ticker over several
    tasks, so that a batch leaves a few files per ticker and not one per task.
    ``writers`` tasks share the rows of one ticker in a batch: as many as its hottest ticker needs.
    Without ``every`` the query ends when the files present are done.
    """
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "ticker"]), F.lit(writers))
    rows = rows.repartition("ticker", spread)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        rows.writeStream.queryName(name).format("parquet").partitionBy("ticker")
        .option("path", path)
        .option("checkpointLocation", checkpoint_folder(rows.sparkSession, name, checkpoint_root))
        .outputMode("append").trigger(**trigger).start()
    )
