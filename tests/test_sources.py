"""Reading, writing and streaming tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketframe.operators import quality as Q
from marketframe.sources import bars as B, series, sinks
from marketframe.streaming import landing

D = dt.date


def bars(spark, rows):
    return spark.createDataFrame([(s, d, 9.0, 11.0, 8.0, c, 100.0, 1000.0, 1.0) for s, d, c in rows], B.BAR_SCHEMA)


def test_bars_round_trip_and_replace_only_their_years(spark, tmp_path):
    path, assets = str(tmp_path / "bars"), spark.createDataFrame([("a",), ("b",)], "symbol string")
    B.write_bars(bars(spark, [("a", D(2020, 1, 2), 10.0), ("a", D(2021, 1, 4), 10.0), ("z", D(2021, 1, 4), 10.0)]), path)
    B.write_bars(bars(spark, [("a", D(2021, 1, 5), 9.5)]), path)
    got = B.read_bars(spark, path, assets)
    assert sorted((r.symbol, r.date, r.close) for r in got.collect()) == [("a", D(2020, 1, 2), 10.0), ("a", D(2021, 1, 5), 9.5)]
    assert [r.symbol for r in B.absent_symbols(got, assets).collect()] == ["b"]
    with pytest.raises(ValueError):
        B.require_all(got, assets)


def test_bad_bars_are_not_written(spark, tmp_path):
    bad = bars(spark, [("a", D(2020, 1, 2), 12.0)])
    assert [r.faults for r in Q.invalid_bars(bad).collect()] == [["high_below_bar"]]
    with pytest.raises(ValueError):
        B.write_bars(bad, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        B.write_bars(bars(spark, [("a", D(2020, 1, 2), 10.0)] * 2), str(tmp_path / "y"))


def test_sinks(spark, tmp_path):
    df = bars(spark, [("a", D(2020, 1, 2), 10.0)])
    sinks.write_tables({"bars": df, "again": df}, str(tmp_path), {"bars": ["symbol"]})
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.parquet(str(tmp_path / "bars")).where("symbol = 'a'").count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0].close == "10.0"
    assert spark.read.json(str(tmp_path / "json")).collect()[0].symbol == "a"
    assert "\"close\":10.0" in sinks.as_json(df, ["symbol"]).collect()[0].record


def test_landed_files_stream_into_current_bars(spark, tmp_path):
    land, table, bad, mark = (str(tmp_path / x) for x in ("land", "table", "bad", "mark"))

    def drop(name, rows):
        spark.createDataFrame(rows, landing.VENDOR_SCHEMA).coalesce(1).write.mode("append").option("header", True).csv(land)

    def run():
        landing.start_refresh(landing.landed_bars(spark, land), table, bad, mark).awaitTermination()

    drop("one", [("a", "20200102", "9", "11", "8", "10", "1", "1", "1"), ("a", "20200103", "9", "11", "8", "10", "1", "1", "n/a")])
    run()
    drop("two", [("a", "20200102", "9", "11", "8", "10.5", "1", "1", "1"), ("a", "20200106", "9", "11", "8", "10", "1", "1", "1")])
    run()
    got = {r.date: (r.close, r.volume, r.amount) for r in landing.current_bars(spark, table).collect()}
    assert got == {D(2020, 1, 2): (10.5, 100.0, 1000.0), D(2020, 1, 6): (10.0, 100.0, 1000.0)}
    assert [r.reason for r in spark.read.parquet(bad).collect()] == ["source_missing_adjustment_factor"]


def test_tail_append_of_an_empty_history(spark):
    fresh = spark.createDataFrame([(D(2020, 1, 2), 1.0)], "date date, close double")
    assert series.append_tail(fresh.where("false"), fresh).count() == 1
    assert series.append_tail(fresh, fresh).count() == 1


def test_forward_references_are_refused(spark):
    from marketframe.functions.timeseries import delta, ref

    for n in (0, -1, True):
        with pytest.raises(ValueError):
            ref(F.col("close"), n)
    with pytest.raises(ValueError):
        delta(F.col("close"), -5)
