"""Rows without a key or a time stay in their own group, in one chunk or in many."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barspark.functions.study import Study
from barspark.operators.bars import latest_bars
from barspark.operators.quality import newest_rows
from barspark.operators.trades import first_k_per_day, non_overlapping
from barspark.plans.chunks import with_row_index
from barspark.plans.scan import exact_quantiles, running, value_scan

ROWS = [("A", "2024-01-01 10:00", 1.0), ("A", "2024-01-02 10:00", 2.0), (None, "2024-01-01 11:00", 3.0), (None, "2024-01-03 11:00", 5.0), ("A", None, 4.0)]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(ROWS, "symbol string, at string, close double")
    return df.select("symbol", F.to_timestamp_ntz("at", F.lit("yyyy-MM-dd HH:mm")).alias("ts"), "close").cache()


def view(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk", [0, 1])
def test_every_row_stays(rows, chunk):
    index = with_row_index(rows)
    assert view(index.select("close", "idx", "n")) == [(1.0, 1, 3), (2.0, 2, 3), (3.0, 0, 2), (4.0, 0, 3), (5.0, 1, 2)]
    total = running(rows, {"sum": ("sum", "close")})
    assert view(total.select("close", "sum")) == [(1.0, 5.0), (2.0, 7.0), (3.0, 3.0), (4.0, 4.0), (5.0, 8.0)]
    study = Study()
    study.out("before", study.prev("close"))
    assert view(study.apply(rows, chunk_rows=chunk).select("close", "before")) == [(1.0, 4.0), (2.0, 1.0), (3.0, None), (4.0, None), (5.0, 3.0)]


def test_scans_keep_the_group_without_key(rows):
    ones = rows.withColumn("one", F.lit(1))
    got = value_scan(ones, "close", ["one"], keys=["symbol"])
    assert view(got.select("symbol", "close", "one_below")) == [("A", 1.0, 0), ("A", 2.0, 1), ("A", 4.0, 2), (None, 3.0, 0), (None, 5.0, 1)]
    assert view(exact_quantiles(rows, "close", [0.5], keys=["symbol"])) == [("A", 0.5, 2.0), (None, 0.5, 4.0)]


@pytest.mark.parametrize("chunk", [0, 1])
def test_trades_without_key(rows, chunk):
    trades = rows.withColumn("exit_ts", F.col("ts") + F.expr("INTERVAL 30 HOURS"))
    assert view(non_overlapping(trades, chunk_rows=chunk).select("close")) == [(1.0,), (3.0,), (5.0,)]


def test_newest_rows_and_caps_have_one_plan(spark, rows):
    assert view(newest_rows(rows, 2, "ts", "symbol").select("close")) == [(2.0,), (5.0,)]
    assert newest_rows(rows, 99, "ts", "symbol").count() == 5
    many = spark.range(5000).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 7).cast("timestamp_ntz").alias("ts"), "id")
    assert [r[0] for r in newest_rows(many, 1700, "ts").orderBy("id").select("id").collect()] == list(range(3300, 5000))
    assert latest_bars(many, n=1500).agg(F.min("id"), F.count("id")).first() == (3500, 1500)
    assert first_k_per_day(many, 2000).count() == 2000
