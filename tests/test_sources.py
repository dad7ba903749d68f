from datetime import datetime
from pathlib import Path

import pytest
from frames import d, dec, dicts, from_rows, raw_bars
from pyspark.sql import functions as F

from eventide.config import StudyConfig
from eventide.schemas import EVENT_SUMMARY, LANDED_BARS, RAW_ANNOUNCEMENTS, RAW_BARS
from eventide.sources.landed import read_announcements, read_bars, rejected
from eventide.sources.layers import read_layer, write_layer
from eventide.sources.manifest import append_manifest, manifest_row

ROWS = [
    ("0700", "2020-01-02", 1.0, 2.0, 0.5, 1.5, 10),
    ("0700", "2020-01-03", None, 2.0, 0.5, 1.5, 11),
    ("AAPL", "2020-01-02", 3.0, 4.0, 2.5, 3.5, 12),
]


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_landed_bars_in_each_format(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    writer = raw_bars(spark, *ROWS).write.format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)
    got = read_bars(spark, path, fmt)
    assert got.schema.fieldNames() == LANDED_BARS.fieldNames()
    assert got.filter("landed_at IS NULL").isEmpty()
    got = got.drop("landed_at")
    assert tuples(got) == sorted(ROWS, key=str)


def test_rows_that_do_not_parse_are_set_aside(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text("ticker,trade_date,open,high,low,close,volume\n"
                    "A,2020-01-02,1,2,0.5,1.5,10\nB,2020-01-02,1,2,0.5,1.5,many\nC,2020-01-02\n")
    assert [r["ticker"] for r in read_bars(spark, str(path), "csv").collect()] == ["A"]
    # The same rows whichever columns are asked for.
    assert read_bars(spark, str(path), "csv").select("ticker").count() == 1
    bad = rejected(spark, str(path), "csv", RAW_BARS)
    assert sorted(r["_corrupt_record"] for r in bad.collect()) == [
        "B,2020-01-02,1,2,0.5,1.5,many", "C,2020-01-02"]


def test_bad_json_line(spark, tmp_path):
    path = tmp_path / "bars.json"
    path.write_text('{"ticker":"A","trade_date":"2020-01-02","close":1.5,"volume":3}\n{"ticker":\n')
    (row,) = read_bars(spark, str(path), "json").collect()
    assert row["ticker"] == "A" and row["open"] is None
    assert rejected(spark, str(path), "json", RAW_BARS).count() == 1


def test_nan_prices_become_null(spark, tmp_path):
    path = str(tmp_path / "p")
    raw_bars(spark, ("A", "2020-01-02", float("nan"), 2.0, 0.5, float("nan"), 1)).write.parquet(path)
    (row,) = read_bars(spark, path).collect()
    assert row["open"] is None and row["close"] is None and row["high"] == 2.0


def test_announcement_key_is_built_when_missing(spark, tmp_path):
    path = str(tmp_path / "e")
    from_rows(spark, [("A", "2020-01-02", None), ("A", "2020-02-02", "own"), ("A", "soon", None)],
              RAW_ANNOUNCEMENTS).write.parquet(path)
    assert {r["event_date"]: r["event_id"] for r in read_announcements(spark, path).collect()} == {
        "2020-01-02": "A_20200102", "2020-02-02": "own", "soon": "A"}


def test_all_null_column_needs_no_inference(spark):
    df = from_rows(spark, [("A", None, None, None, None, None, None)], RAW_BARS)
    assert df.schema == RAW_BARS


def test_ticker_of_digits_survives_partitioning(spark, tmp_path):
    path = str(tmp_path / "t")
    assert write_layer(raw_bars(spark, *ROWS), path, "ticker", ["trade_date"]) == 3
    assert tuples(read_layer(spark, path, RAW_BARS)) == sorted(ROWS, key=str)
    assert read_layer(spark, path, RAW_BARS).filter("ticker = '0700'").count() == 2


def test_replace_all_or_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    write_layer(raw_bars(spark, *ROWS), path, "ticker")
    new = raw_bars(spark, ("AAPL", "2021-01-04", 1.0, 1.0, 1.0, 1.0, 99))
    assert write_layer(new, path, "ticker", replace="touched") == 1
    assert sorted(r["volume"] for r in read_layer(spark, path, RAW_BARS).collect()) == [10, 11, 99]
    write_layer(new, path, "ticker")
    assert [r["volume"] for r in read_layer(spark, path, RAW_BARS).collect()] == [99]
    with pytest.raises(ValueError):
        write_layer(new, path, "ticker", replace="some")


def test_empty_input_is_not_written(spark, tmp_path):
    path = tmp_path / "t"
    assert write_layer(raw_bars(spark), str(path), "ticker", skip_empty=True) == 0
    assert not path.exists()


def test_empty_tables_can_be_written_and_counted(spark, tmp_path):
    path = str(tmp_path / "t")
    assert write_layer(raw_bars(spark), path, "ticker", ["trade_date"]) == 0
    assert read_layer(spark, path, RAW_BARS).isEmpty()
    assert write_layer(raw_bars(spark, *ROWS).filter("1 = 0"), path, sort_by=["ticker"]) == 0


def test_missing_layer(spark, tmp_path):
    path = str(tmp_path / "none")
    assert read_layer(spark, path, EVENT_SUMMARY, missing_ok=True).isEmpty()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_layer(spark, path, EVENT_SUMMARY)


def test_small_tickers_get_one_file_and_a_hot_one_several(spark, tmp_path):
    path = tmp_path / "t"
    hot = spark.range(400_000).select(F.lit("HOT").alias("ticker"), "id", F.rand(1).alias("x"))
    rest = spark.range(3000).select(
        F.concat(F.lit("T"), (F.col("id") % 3).cast("string")).alias("ticker"), "id",
        F.rand(2).alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        assert write_layer(hot.unionByName(rest).repartition(16), str(path), "ticker", ["id"]) == 403_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {p.name: len(list(p.glob("*.parquet"))) for p in Path(path).glob("v=*/ticker=*")}
    assert files["ticker=HOT"] >= 4
    assert all(n == 1 for name, n in files.items() if name != "ticker=HOT"), files


def test_manifest_appends_one_line_per_run(spark, tmp_path):
    path = str(tmp_path / "m")
    for day in (1, 2):
        append_manifest(manifest_row(spark, datetime(2024, 1, day), ["A", "B"], StudyConfig(),
                                     {"prices": day, "announcements": 0}), path)
    rows = dicts(spark.read.json(path), "run_ts")
    assert len(rows) == 2 and rows[1]["row_counts"]["prices"] == 2
    assert rows[0]["tickers"] == ["A", "B"] and rows[0]["analysis_end"] == "2024-12-31"
