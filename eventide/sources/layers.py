"""Parquet layers: typed reads of one version, counted writes of the next."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.sources.snapshots import Snapshot, commit, current, drop_folder, expire, fresh_folder, remaining


def shared_folder(spark: SparkSession) -> str:
    """A new folder where all machines of the cluster can read and write.

    Under the one the cluster names; in a temporary one of this machine where all work is local.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if shared is None and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(shared or tempfile.mkdtemp(prefix='eventide-')).rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to a folder of its own and read back: what follows starts from files."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_layer(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = False,
               version: Snapshot | None = None) -> DataFrame:
    """Read a layer with its declared schema, so a ticker such as ``0700`` stays text.

    The current version is looked up once, here: what is written later does not change the result.
    ``version`` reads another one. A folder of files without versions is read as it is.
    """
    version = version or current(spark, path)
    reader = spark.read.schema(schema)
    try:
        if version is None:
            frames = [reader.parquet(path)]
        else:
            # Partitions from before there were versions lie one level higher.
            taken_over = {f: p for f, p in version.folders.items() if not f}
            own = {f: p for f, p in version.folders.items() if f}
            frames = [reader.option("basePath", path).parquet(*version._replace(folders=folders).paths(path))
                      for folders in (taken_over, own) if folders]
        # Partition columns come last in files; the declared order is restored.
        frames = [frame.select(*schema.fieldNames()) for frame in frames]
        return reduce(DataFrame.unionAll, frames) if frames else spark.createDataFrame([], schema)
    except AnalysisException as error:
        if missing_ok and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_observed(
    df: DataFrame,
    path: str,
    partition_by: str | None = None,
    sort_by: Sequence[str] = (),
    replace: str = "all",
    skip_empty: bool = False,
    observe: Mapping[str, Column] | None = None,
    keep: int = 2,
    touched: Iterable[str] = (),
    note: Mapping | None = None,
    audit: Callable[[Mapping, int], None] | None = None,
) -> dict[str, int]:
    """Write a new version of a layer and return its row count as ``rows``, taken while writing.

    With ``partition_by`` the rows are rebalanced on that column first: small partitions end up in
    one file, and AQE splits a partition that holds far more than the rest, so a hot value is
    written by many tasks. ``replace="touched"`` replaces only partitions present in ``df``,
    ``"none"`` adds rows to those there are, ``"all"`` replaces the whole table. ``skip_empty``
    leaves the layer as it is when ``df`` has no rows. ``observe`` adds aggregates, taken in the same
    write. ``keep`` versions stay readable, and the layer is the old one until all is written.
    ``touched`` names partition folders that are replaced though ``df`` may have no row of them.
    ``note`` is stored with the version. ``audit`` is shown what was observed and the number of the
    new version before readers see it; if it raises, the version is dropped and the old one stays.
    """
    if replace not in ("all", "touched", "none"):
        raise ValueError("replace must be 'all', 'touched' or 'none'")
    spark = df.sparkSession
    if partition_by:
        df = df.hint("rebalance", F.col(partition_by))
        df = df.sortWithinPartitions(partition_by, *sort_by)
    elif sort_by:
        df = df.orderBy(*sort_by)
    written = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (observe or {}).items()]]
    before = current(spark, path)
    folder = fresh_folder(before)
    writer = df.observe(written, *counts).write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{path.rstrip('/')}/{folder}")
    found = dict(written.get)
    some = replace == "touched" and partition_by is not None
    gone = list(touched)
    if not found["rows"] and (skip_empty or (before and not gone and (some or replace == "none"))):
        drop_folder(spark, path, folder)
        return found
    if audit:
        try:
            audit(found, before.id + 1 if before else 1)
        except Exception:
            drop_folder(spark, path, folder)
            raise
    stays = remaining(spark, path, before, folder, gone) if some else (
        before.folders if before and replace == "none" else {})
    commit(spark, path, before, {**stays, folder: None}, keep, note)
    expire(spark, path)
    return found


def write_layer(df: DataFrame, path: str, partition_by: str | None = None, sort_by: Sequence[str] = (),
                replace: str = "all", skip_empty: bool = False, keep: int = 2) -> int:
    """`write_observed` with the row count alone."""
    return write_observed(df, path, partition_by, sort_by, replace, skip_empty, keep=keep)["rows"]
