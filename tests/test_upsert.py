"""Newly landed rows merged into all tables against a run over everything that ever landed."""

from collections import Counter
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from frames import raw_bars
from pyspark.sql import functions as F

from eventide.config import StudyConfig
from eventide.plans import catalog
from eventide.plans import pipeline as plans
from eventide.plans.pipeline import Pipeline
from eventide.schemas import (
    ANNOUNCEMENTS, BARS, COHORTS, EVENT_DAY_METRICS, EVENT_SUMMARY, TRADE_SESSIONS)
from eventide.sources import layers
from eventide.sources.layers import read_layer

CONFIG = StudyConfig(start=date(2020, 1, 1), end=date(2020, 12, 31))
TABLES = {"silver/prices": BARS, "silver/announcements": ANNOUNCEMENTS, "gold/event_day_metrics": EVENT_DAY_METRICS,
          "gold/event_summary": EVENT_SUMMARY, "gold/daily_cohort_metrics": COHORTS,
          "gold/trade_sessions": TRADE_SESSIONS}


def bar(ticker, day, price, volume=100):
    return ticker, day, price, price + 1, price - 1, price, volume


def announced(spark, *rows):
    return spark.createDataFrame(list(rows), "ticker string, event_date string, event_id string")


FIRST = ([bar(t, f"2020-03-{d:02d}", 10.0 + d + i) for i, t in enumerate(("A", "B", "C")) for d in range(2, 28)],
         [(t, f"2020-03-{d:02d}", f"{t}_{d}") for t in ("A", "B", "C") for d in (10, 20)])
BATCHES = [
    # A correction, a new day, an unusable row, a new ticker.
    ([bar("A", "2020-03-09", 99.0), bar("A", "2020-03-28", 50.0), bar("B", "2020-03-05", 1.0, 0),
      bar("D", "2020-03-10", 5.0), bar("D", "2020-03-09", 4.0)], []),
    # An event under another name, a new event, one of a ticker without bars, and one without a ticker.
    ([], [("B", "2020-03-10", "B_ten"), ("B", "2020-03-15", "B_15"), ("E", "2020-03-10", "E_10"), (None, "2020-03-10", "x")]),
    # Two events under one name; bars of a ticker without events; text that is no date.
    ([bar("E", "2020-03-09", 3.0), bar("E", "2020-03-10", 4.0), bar("F", "2020-03-10", 4.0)],
     [("C", "2020-03-12", "C_10"), ("D", "soon", "D_x")]),
    ([], []),
]


def load(spark, batch):
    return raw_bars(spark, *batch[0]), announced(spark, *batch[1])


def same_tables(spark, one, other):
    for name, schema in TABLES.items():
        a, b = (read_layer(spark, f"{root}/{name}", schema) for root in (one, other))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_upserts_equal_a_run_over_everything(spark, tmp_path):
    grown, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    run = Pipeline(spark, grown, CONFIG)
    run.run(*load(spark, FIRST), datetime(2024, 1, 1))
    landed = [tuple(x.withColumn("landed_at", F.lit(datetime(2024, 1, 1))) for x in load(spark, FIRST))]
    for n, batch in enumerate(BATCHES, 2):
        counts = run.upsert(*load(spark, batch), datetime(2024, 1, n))
        assert bool(counts.get("silver")) == bool(batch[0] or batch[1])
        landed.append(tuple(x.withColumn("landed_at", F.lit(datetime(2024, 1, n))) for x in load(spark, batch)))
    bars, events = landed[0]
    for more in landed[1:]:
        bars, events = bars.unionByName(more[0]), events.unionByName(more[1])
    Pipeline(spark, whole, CONFIG).run(bars, events, datetime(2024, 2, 1))
    same_tables(spark, grown, whole)


def test_other_tickers_are_neither_read_nor_written(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    run = Pipeline(spark, root, CONFIG)
    run.run(*load(spark, FIRST), datetime(2024, 1, 1))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("ticker=[BC]/*.parquet")}
    plans_seen = []
    write = plans.write_observed

    def watched(df, path, *args, **how):
        if "cohort" not in path:
            plans_seen.append(set(df.inputFiles()))
        return write(df, path, *args, **how)

    monkeypatch.setattr(plans, "write_observed", watched)
    run.upsert(*load(spark, BATCHES[0]), datetime(2024, 1, 2))
    # Ticker B has a new row of its own, C has none.
    read = set().union(*plans_seen)
    assert any("ticker=A" in f for f in read) and not any("ticker=C" in f for f in read)
    assert {p: p.stat().st_mtime_ns for p in files if "ticker=C" in str(p)} == {
        p: t for p, t in files.items() if "ticker=C" in str(p)}


@pytest.mark.parametrize("stop_at", ["silver/announcements", "gold/event_summary", "gold/daily_cohort_metrics"])
def test_an_upsert_that_ended_early_is_finished_by_the_next(spark, tmp_path, monkeypatch, stop_at):
    grown, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    run = Pipeline(spark, grown, CONFIG)
    run.run(*load(spark, FIRST), datetime(2024, 1, 1))
    batch = (BATCHES[0][0], BATCHES[1][1])
    commit = layers.commit

    def killed(spark_, path, *args):
        if path.endswith(stop_at):
            raise KeyboardInterrupt
        return commit(spark_, path, *args)

    with monkeypatch.context() as patch:
        patch.setattr(layers, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            run.upsert(*load(spark, batch), datetime(2024, 1, 2))
    run.catch_up()
    other = Pipeline(spark, whole, CONFIG)
    other.run(*load(spark, FIRST), datetime(2024, 1, 1))
    other.upsert(*load(spark, batch), datetime(2024, 1, 2))
    same_tables(spark, grown, whole)


def test_first_upsert_builds_everything(spark, tmp_path):
    grown, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    Pipeline(spark, grown, CONFIG).upsert(*load(spark, FIRST), datetime(2024, 1, 1))
    Pipeline(spark, whole, CONFIG).run(*load(spark, FIRST), datetime(2024, 1, 1))
    same_tables(spark, grown, whole)


def star_tables(spark, folder):
    """Line items of two nations on 40 days, one of which is odd; orders on the 10th and the 20th."""
    days = [datetime(1998, 4, 1) + timedelta(n) for n in range(40)]
    lines = [(n, n, nation, 1, 5.0 + n, 100.0 + n * (nation + 1), 0.05, "N", "F", day)
             for nation in (3, 4) for n, day in enumerate(days)]
    orders = [(n, nation, datetime(1998, 4, day), f"{n}-P") for nation in (3, 4) for n, day in enumerate((10, 20))]
    for name, rows, schema in (
            ("nation", [(3, "NATION_3"), (4, "NATION_4")], "n_nationkey int, n_name string"),
            ("supplier", [(3, 3), (4, 4)], "s_suppkey long, s_nationkey int"),
            ("customer", [(3, 3), (4, 4)], "c_custkey long, c_nationkey int"),
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
             "l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, "
             "l_shipdate timestamp")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_two_landings_read_the_tables_once(spark, tmp_path, monkeypatch):
    folder = star_tables(spark, tmp_path / "star")
    read, landings = Counter(), []

    def watch(module, function):
        own = getattr(module, function)

        def watched(df, *args, **how):
            read.update({Path(f).parent.name for f in df.inputFiles() if folder in f})
            found = own(df, *args, **how)
            if args and "bronze/prices" in args[0]:
                landings.append(found["rows"])
            return found

        monkeypatch.setattr(module, function, watched)

    watch(plans, "write_observed")
    watch(catalog, "stored")
    got = catalog.queries()["upserted_event_summary"](spark, folder)
    assert read["lineitem.parquet"] == 1 and read["orders.parquet"] == 1
    # April 16th to 30th of the odd nation lands later, and no row lands twice.
    assert landings == [65, 15]
    expected = catalog.queries()["study_of_cleaned_rows"](spark, folder)
    assert got.count() == 4 and got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()
