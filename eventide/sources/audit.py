"""Figures of each write, stored beside its layer, and the gates it has to pass to be published."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.quality import Gates
from eventide.schemas import QUALITY
from eventide.sources.snapshots import put_text


class GateFailed(RuntimeError):
    """A write that was not published."""


def read_figures(spark: SparkSession, folder: str) -> DataFrame:
    """All figures stored in a folder; no rows where nothing was."""
    try:
        return spark.read.schema(QUALITY).json(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], QUALITY)
        raise


class Audit:
    """Stores what was observed while a table was written, and refuses what its gates do not let pass.

    The figures come from the last stage of the write, so nothing is scanned for them and a lost
    executor counts no row twice. Those of a refused write are stored too, with the reason.
    """

    def __init__(self, spark: SparkSession, folder: str, table_name: str, written: str, gates: Gates = Gates()) -> None:
        self.spark, self.folder, self.table_name, self.written, self.gates = spark, folder, table_name, written, gates

    def _last_rows(self) -> float | None:
        of = (F.col("table_name") == self.table_name) & (F.col("written") == self.written)
        rows = read_figures(self.spark, self.folder).filter(
            of & (F.col("measure") == "rows") & F.col("failed").isNull())
        return rows.agg(F.max_by("value", "version")).first()[0]

    def __call__(self, found: Mapping[str, float | None], version: int) -> None:
        last = self._last_rows() if self.gates.rows_of_last is not None else None
        failures = self.gates.failures(found, last)
        lines = []
        for name, value in found.items():
            measure, _, column = name.partition(":")
            lines.append(json.dumps({
                "table_name": self.table_name, "version": version, "written": self.written,
                "column_name": column or "*", "measure": measure,
                "value": None if value is None else float(value), "failed": "; ".join(failures) or None}))
        put_text(self.spark, self.folder, f"{version:09d}-{uuid.uuid4().hex}.json", "\n".join(lines) + "\n")
        if failures:
            raise GateFailed(f"{self.table_name}: {'; '.join(failures)}")
