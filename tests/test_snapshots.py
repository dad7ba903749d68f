"""Versions of tables: what readers see while, and after, writes end or do not."""

import pytest
from frames import raw_bars

from eventide.plans import serve
from eventide.schemas import COHORTS, RAW_BARS
from eventide.sources import layers, snapshots
from eventide.sources.layers import read_layer, write_layer


def rows(spark, *pairs):
    return raw_bars(spark, *[(t, "2020-01-02", 1.0, 1.0, 1.0, 1.0, n) for t, n in pairs])


def held(frame):
    return sorted((r.ticker, r.volume) for r in frame.collect())


def stored(spark, path):
    return held(read_layer(spark, path, RAW_BARS))


@pytest.mark.parametrize(("step", "replace"), [
    ("remaining", "touched"), ("commit", "all"), ("commit", "touched"), ("commit", "none"),
    ("expire", "all"), ("expire", "touched"), ("expire", "none")])
def test_a_write_that_ends_between_steps(spark, tmp_path, monkeypatch, step, replace):
    path = str(tmp_path / "t")
    write_layer(rows(spark, ("A", 1), ("B", 1)), path, "ticker")
    before = read_layer(spark, path, RAW_BARS)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(layers, step, killed)
        with pytest.raises(KeyboardInterrupt):
            write_layer(rows(spark, ("B", 2)), path, "ticker", replace=replace)
    new = {"all": [("B", 2)], "touched": [("A", 1), ("B", 2)], "none": [("A", 1), ("B", 1), ("B", 2)]}[replace]
    assert stored(spark, path) == (new if step == "expire" else [("A", 1), ("B", 1)])
    assert held(before) == [("A", 1), ("B", 1)]
    # The next run is not in the way of what was left behind.
    write_layer(rows(spark, ("C", 3)), path, "ticker")
    assert stored(spark, path) == [("C", 3)]


def test_the_pointer_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    write_layer(rows(spark, ("A", 1)), path, "ticker")
    replace = snapshots._Files.replace

    def half(self, name, text):
        replace(self, "_elsewhere", text)
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(snapshots._Files, "replace", half)
        with pytest.raises(KeyboardInterrupt):
            write_layer(rows(spark, ("A", 2)), path, "ticker")
    assert stored(spark, path) == [("A", 1)]


def test_touched_partitions_are_not_copied(spark, tmp_path):
    path = str(tmp_path / "t")
    write_layer(rows(spark, ("A", 1), ("B", 1), ("0700", 1)), path, "ticker")
    (first,) = snapshots.current(spark, path).folders
    write_layer(rows(spark, ("B", 2)), path, "ticker", replace="touched")
    now = snapshots.current(spark, path)
    assert now.folders[first] == ["ticker=0700", "ticker=A"] and len(now.folders) == 2
    write_layer(rows(spark, ("A", 3), ("0700", 3)), path, "ticker", replace="touched")
    assert stored(spark, path) == [("0700", 3), ("A", 3), ("B", 2)]
    assert first not in snapshots.current(spark, path).folders
    text = read_layer(spark, path, RAW_BARS).filter("ticker = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in text


def test_old_versions_are_read_until_they_expire(spark, tmp_path):
    path = str(tmp_path / "t")
    kept = []
    for n in range(1, 4):
        write_layer(rows(spark, ("A", n)), path, "ticker", keep=2)
        kept.append(snapshots.current(spark, path))
    assert [v.id for v in kept] == [1, 2, 3]
    assert held(read_layer(spark, path, RAW_BARS, version=kept[1])) == [("A", 2)]
    assert not list(tmp_path.glob("t/v=000000001*")) and len(list(tmp_path.glob("t/v=*"))) == 2


def test_an_unfinished_write_is_removed_by_a_later_one(spark, tmp_path):
    path = str(tmp_path / "t")
    write_layer(rows(spark, ("A", 1)), path, "ticker")
    (tmp_path / "t" / "v=000000002-dead" / "ticker=A").mkdir(parents=True)
    assert snapshots.expire(spark, path) == []
    write_layer(rows(spark, ("A", 2)), path, "ticker")
    assert not (tmp_path / "t" / "v=000000002-dead").exists()


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    write_layer(rows(spark, ("A", 1)), path, "ticker")
    based = snapshots.current(spark, path)
    write_layer(rows(spark, ("A", 2)), path, "ticker")
    with pytest.raises(snapshots.StaleWrite):
        snapshots.commit(spark, path, based, {})
    assert stored(spark, path) == [("A", 2)]


def test_a_table_without_versions_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "t")
    rows(spark, ("A", 1), ("B", 1)).write.partitionBy("ticker").parquet(path)
    assert stored(spark, path) == [("A", 1), ("B", 1)]
    write_layer(rows(spark, ("B", 2)), path, "ticker", replace="touched")
    assert stored(spark, path) == [("A", 1), ("B", 2)]


def cohort(spark, n):
    return spark.createDataFrame([(n, "MID", n, None, None, None, None)], COHORTS)


@pytest.mark.parametrize("keep", [False, True])
def test_lookups_keep_their_version_until_reload(spark, tmp_path, keep):
    path = str(tmp_path / "daily_cohort_metrics")
    write_layer(cohort(spark, 1), path)
    gold = serve.GoldTables(spark, str(tmp_path), keep=keep)
    running = gold.cohorts()
    assert running.first().event_count == 1
    write_layer(cohort(spark, 2), path)
    assert gold.cohorts().first().event_count == 1 and gold.versions()["daily_cohort_metrics"] == 1
    gold.reload()
    assert gold.cohorts().first().event_count == 2
    assert running.first().event_count == 1 and running.is_cached == keep
    fresh = gold.cohorts()
    gold.reload()
    # Nothing new was written: what was kept stays kept.
    assert gold.cohorts().is_cached == keep and (not keep or gold.cohorts() is fresh)
    assert not running.is_cached
    gold.reload()
