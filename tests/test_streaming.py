"""Streams over files against their batch twins and small hand-made cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.catalog.runs import drain
from barspark.operators.bars import rollup_bars
from barspark.streaming import jobs as J
from tests.conftest import to_spark, walk

T0 = pd.Timestamp("2024-05-06 08:00")


def at(minutes: float) -> pd.Timestamp:
    return T0 + pd.Timedelta(minutes=minutes)


def as_stream(spark, frame: pd.DataFrame, folder, files: int = 1):
    # Files are read in the order they were written, so they are written one after the other.
    ordered = frame.sort_values("ts", kind="stable")
    for at_ in np.array_split(np.arange(len(ordered)), files):
        part = ordered.iloc[at_]
        df = to_spark(spark, part)
        df.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_closed_bars_equal_batch(spark, tmp_path):
    f = walk(600, 4)
    out = drain(J.stream_bars(as_stream(spark, f, tmp_path / "in", 4), "15 minutes", "5 minutes")).toPandas()
    want = rollup_bars(to_spark(spark, f), "15 minutes").toPandas()
    both = out.merge(want, on=["symbol", "ts"], suffixes=("", "_w"))
    assert len(both) == len(out) >= len(want) - 2
    for c in ("open", "high", "low", "close", "volume"):
        assert (both[c] == both[f"{c}_w"]).all()


def test_gate_time_left(spark):
    rows = [(0.7, 20.0, "2024-05-06 18:00"), (0.69, 20.0, "2024-05-06 18:00"), (0.9, 10.0, "2024-05-06 18:00"), (0.9, 40.0, "2024-05-06 20:30"), (0.9, 30.0, "2024-05-06 20:30")]
    df = spark.createDataFrame(rows, "probability double, expected_minutes double, t string").withColumn("ts", F.to_timestamp("t"))
    kept = [tuple(r) for r in J.stream_gate(df).select("probability", "expected_minutes").collect()]
    assert kept == [(0.7, 20.0), (0.9, 30.0)]


def test_signal_life(spark, tmp_path):
    rows = [
        ("A", at(0), 0.80, 3.0, True),
        ("A", at(5), 0.75, 3.0, False),
        ("A", at(9), 0.72, 3.0, False),
        ("B", at(1), 0.90, 30.0, True),
        ("B", at(6), 0.60, 30.0, False),
        ("C", at(2), 0.90, 10.0, True),
        ("Z", at(120), 0.1, 1.0, False),
    ]
    f = pd.DataFrame(rows, columns=["symbol", "ts", "probability", "expected_minutes", "is_signal"])
    out = drain(J.stream_signal_life(as_stream(spark, f, tmp_path / "s"), "1 minute")).toPandas()
    got = sorted((r.symbol, r.state, r.event_ts) for r in out.itertuples())
    assert got == sorted(
        [
            ("A", "active", at(0)),
            ("A", "expired", at(8)),
            ("B", "active", at(1)),
            ("B", "cancelled", at(6)),
            ("C", "active", at(2)),
            ("C", "expired", at(17)),
        ]
    )


def test_positions(spark, tmp_path):
    pos = pd.DataFrame(
        [("A", at(0), "p1", 100.0, 99.0, 102.0, 0.8), ("A", at(0), "p2", 100.0, 95.0, 110.0, 0.7)],
        columns=["symbol", "ts", "position_id", "entry_price", "sl_price", "tp_price", "probability"],
    )
    bars = pd.DataFrame([("A", at(1), 101.0, 99.5), ("A", at(2), 102.5, 100.0), ("A", at(3), 103.0, 94.0)], columns=["symbol", "ts", "high", "low"])
    out = drain(J.stream_positions(as_stream(spark, pos, tmp_path / "p"), as_stream(spark, bars, tmp_path / "b"))).toPandas()
    got = sorted((r.position_id, r.reason, r.exit_ts, r.pnl, r.predicted_rr, r.actual_rr) for r in out.itertuples())
    assert got == [("p1", "target", at(2), 2.0, 2.0, 2.0), ("p2", "stop", at(3), -5.0, 2.0, -1.0)]


def test_late_and_repeated_rows(spark, tmp_path):
    f = pd.concat([walk(100, 4), walk(100, 4).tail(20)])
    out = drain(J.stream_dedup(as_stream(spark, f, tmp_path / "d", 2), "1 hour").select("symbol", "ts"))
    assert out.count() == len(walk(100, 4))


def test_batch_scoring_reads_only_touched_symbols(spark):
    stored = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "symbol string, x int")
    seen = []
    body = J.score_each_batch(lambda df: df, lambda df, epoch: seen.append((epoch, sorted(r["symbol"] for r in df.collect()))), lambda: stored)
    body(spark.createDataFrame([("B",), ("B",)], "symbol string"), 7)
    assert seen == [(7, ["B"])]
