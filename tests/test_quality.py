"""Figures taken while writing, and the gates a write has to pass."""

from datetime import datetime

import pytest
from frames import dicts, raw_bars
from pyspark.sql import functions as F

from eventide.config import StudyConfig
from eventide.operators.quality import Gates, column_figures
from eventide.plans.pipeline import Pipeline
from eventide.schemas import RAW_ANNOUNCEMENTS
from eventide.sources import layers
from eventide.sources.audit import GateFailed
from eventide.sources.snapshots import current

RUN = datetime(2024, 7, 1)
GOOD = [("A", "2024-06-10", 1.0, 2.0, 0.5, 1.5, 100), ("A", "2024-06-11", None, 2.0, 0.5, 2.5, 100),
        ("B", "2024-06-10", 1.0, 2.0, 0.5, 9.0, 100)]
BAD = [("A", "2024-06-12", 1.0, 2.0, 0.5, None, 100), ("B", "2024-06-12", 1.0, 2.0, 0.5, 3.0, 0)]


def announced(spark, *rows):
    return spark.createDataFrame(list(rows) or [("A", "2024-06-10", "e1")], RAW_ANNOUNCEMENTS)


def pipeline(spark, tmp_path, **gates):
    return Pipeline(spark, str(tmp_path), StudyConfig(), gates={k.replace("_", "/"): g for k, g in gates.items()})


def figure(run, table, column, measure, version=1):
    wanted = {"table_name": table, "column_name": column, "measure": measure, "version": version}
    (row,) = [r for r in dicts(run.quality()) if all(r[k] == v for k, v in wanted.items())]
    return row["value"], row["last_value"]


def test_figures_of_each_write(spark, tmp_path):
    run = pipeline(spark, tmp_path)
    run.load_bronze(raw_bars(spark, *GOOD, *BAD), announced(spark), RUN)
    run.build_silver()
    assert figure(run, "bronze/prices", "*", "rows") == (5, None)
    assert figure(run, "bronze/prices", "*", "rejected") == (2, None)
    assert figure(run, "silver/prices", "*", "rows") == (3, None)
    assert figure(run, "silver/prices", "open", "nulls") == (1, None)
    assert figure(run, "silver/prices", "close", "least") == (1.5, None)
    assert figure(run, "silver/prices", "close", "greatest") == (9, None)
    assert figure(run, "silver/prices", "trade_date", "greatest") == (19885, None)
    run.load_bronze(raw_bars(spark, *GOOD), announced(spark), RUN)
    run.build_silver()
    assert figure(run, "bronze/prices", "*", "rows", 2) == (3, 5)
    assert figure(run, "bronze/prices", "*", "rejected", 2) == (0, 2)


def test_figures_read_no_table(spark, tmp_path, monkeypatch):
    run = pipeline(spark, tmp_path)
    run.load_bronze(raw_bars(spark, *GOOD), announced(spark), RUN)
    run.build_silver()
    plan = run.quality()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and not run.quality().inputFiles()[0].endswith(".parquet")


def test_merged_partitions_are_compared_with_merged_ones(spark, tmp_path):
    run = pipeline(spark, tmp_path)
    run.run(raw_bars(spark, *GOOD), announced(spark), RUN)
    for day in ("2024-06-13", "2024-06-14"):
        run.upsert(raw_bars(spark, ("A", day, 1.0, 1.0, 1.0, 1.0, 5)), announced(spark).limit(0), RUN)
    assert figure(run, "silver/prices", "*", "rows", 1) == (3, None)
    assert figure(run, "silver/prices", "*", "rows", 2) == (3, None)
    assert figure(run, "silver/prices", "*", "rows", 3) == (4, 3)


@pytest.mark.parametrize("table, gates", [
    ("silver_prices", Gates(null_share={"open": 0.1})),
    ("silver_prices", Gates(ranges={"close": (None, 5.0)})),
    ("silver_prices", Gates(ranges={"close": (2.0, None)})),
    ("silver_prices", Gates(ranges={"trade_date": (19885, None)})),
    ("bronze_prices", Gates(rejected_share=0.3)),
])
def test_a_failed_gate_leaves_the_old_version(spark, tmp_path, table, gates):
    good = ("A", "2024-06-11", 3.0, 3.0, 3.0, 3.0, 100)
    run = pipeline(spark, tmp_path, **{table: gates})
    run.load_bronze(raw_bars(spark, good), announced(spark), RUN)
    run.build_silver()
    before = run.silver_bars()
    with pytest.raises(GateFailed):
        run.load_bronze(raw_bars(spark, *GOOD, *BAD), announced(spark), RUN)
        run.build_silver()
    path = f"{tmp_path}/{table.replace('_', '/')}"
    assert current(spark, path).id == 1
    assert dicts(run.silver_bars()) == dicts(before) and before.count() == 1
    refused = run.quality().filter(F.col("failed").isNotNull() & (F.col("measure") == "rows"))
    assert [(r["table_name"], r["version"]) for r in refused.collect()] == [(table.replace("_", "/"), 2)]
    # What passes later is compared with what was published, under the same number as the refused write.
    run.load_bronze(raw_bars(spark, good), announced(spark), RUN)
    run.build_silver()
    passed = run.quality().filter(f"failed IS NULL AND version = 2 AND measure = 'rows' "
                                  f"AND table_name = '{table.replace('_', '/')}'")
    assert [(r["value"], r["last_value"]) for r in passed.collect()] == [(1, 1)]


def test_rows_of_the_last_published_write(spark, tmp_path):
    run = pipeline(spark, tmp_path, bronze_prices=Gates(rows_of_last=0.5))
    run.load_bronze(raw_bars(spark, *GOOD), announced(spark), RUN)
    for _ in range(2):
        with pytest.raises(GateFailed, match="1 rows after 3"):
            run.load_bronze(raw_bars(spark, GOOD[0]), announced(spark), RUN)
    run.load_bronze(raw_bars(spark, *GOOD[:2]), announced(spark), RUN)
    assert current(spark, f"{run.bronze}/prices").id == 2


def test_no_rows_and_odd_names(spark, tmp_path):
    df = spark.range(0).select(F.col("id").alias("a`b"), F.current_date().alias("c.d"), F.lit("x").alias("rows"))
    found = layers.write_observed(df, str(tmp_path / "t"), observe=column_figures(df.schema))
    assert found == {"rows": 0, "nulls:a`b": 0, "least:a`b": None, "greatest:a`b": None, "nulls:c.d": 0,
                     "least:c.d": None, "greatest:c.d": None, "nulls:rows": 0}
    assert Gates(null_share={"a`b": 0.0}, ranges={"a`b": (0, 1)}).failures(found) == []
