"""Written tables between steps, in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; where that is unset, a temporary one if all work is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="eventide-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Rows of a file, where their number is known before.
FILE_ROWS, LEAST_FILES = 1_000_000, 8


def settle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What follows starts from files: it runs the steps above only once, and a lost executor costs
    only what it was working on. ``rows``, the most there can be, keeps small tables in few files.
    """
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/eventide/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._settled_at = path
    return table


# Tables settled inside of each open `scratch`.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope at whose end all tables settled in it are removed, but for those given to what it
    yields. Results that read them must be written before.
    """
    _SCOPES.append([])

    def keep(table: DataFrame) -> DataFrame:
        _SCOPES[-1].remove(table._settled_at)
        return table

    try:
        yield keep
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def discard(table: DataFrame) -> None:
    """Remove a settled table that nothing will read again."""
    for paths in _SCOPES:
        if table._settled_at in paths:
            paths.remove(table._settled_at)
    _remove(table.sparkSession, table._settled_at)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often and deep it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def find_package(spark: SparkSession) -> None:
    """Let workers on this machine import the package from where the driver did.

    On a cluster the package is installed or sent along with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
