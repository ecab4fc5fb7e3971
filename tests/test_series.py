"""The written cut of a series, its reads of the input, and step functions that combine in a tree."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.operators import metrics as M
from barspark.operators import trades as K
from barspark.plans import steps
from barspark.plans.series import IDX, LEN, STRETCH, cut_series
from barspark.session import clear_written, cut_lineage
from tests.conftest import same, to_pandas, to_spark, walk


@pytest.fixture(scope="module")
def bars(spark):
    return to_spark(spark, pd.concat([walk(3000, 5, symbol="HOT"), walk(90, 6, symbol="COLD")])).cache()


@pytest.mark.parametrize("part_rows", [None, 50, 700])
def test_positions_and_frames(bars, part_rows):
    cut = cut_series(bars, part_rows=part_rows)
    w = Window.partitionBy("symbol").orderBy("ts")
    want = to_pandas(bars.select("*", (F.row_number().over(w) - 1).alias("i"), F.sum("close").over(w.rowsBetween(-120, 40)).alias("s"), F.lag("close").over(w).alias("p")))
    rows = cut.chunks(120, 40, 100)
    got = rows.trim(rows.df.withColumns({"s": F.sum("close").over(rows.line.between(-120, 40)), "p": rows.line.prev("close")}))
    got = to_pandas(got)
    assert (got[IDX] == want["i"]).all() and (got[LEN] == got.groupby("symbol")["ts"].transform("size")).all()
    same(got, want, ["s", "p"])
    before = to_pandas(cut.running({"b": ("sum", "close")}, before=True).rows)
    assert np.allclose(before["b"].fillna(0), want.groupby("symbol")["close"].cumsum() - want["close"])


def test_a_crowded_day_is_many_stretches(spark):
    one_day = spark.range(20_000).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 4).cast("timestamp_ntz").alias("ts"))
    sizes = cut_series(one_day, part_rows=1000).df.groupBy(STRETCH).count().toPandas()["count"]
    assert len(sizes) > 10 and sizes.max() < 4000


def counted(spark, df):
    """The same rows, and a counter of how often one was read."""
    reads = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema), reads


def test_several_steps_read_their_input_twice(spark):
    f = pd.concat([walk(400, 7, symbol="A"), walk(200, 8, symbol="B")])
    f["exit_ts"] = f.ts + pd.Timedelta(minutes=7)
    f["pnl"] = np.sin(np.arange(len(f)))
    trades = to_spark(spark, f)
    for run in (
        lambda t: K.non_overlapping(t, max_per_day=3, chunk_rows=None),
        lambda t: K.trade_equity(t),
        lambda t: K.equity_curve(t.select("symbol", "ts"), trades),
        lambda t: K.compound_trades(t.withColumnsRenamed({"open": "entry_price", "close": "exit_price"}), F.lit(1e-6)),
        lambda t: M.max_drawdown(t.withColumns({"seq": F.unix_micros(F.col("ts").cast("timestamp")), "equity": F.col("close")})),
    ):
        source, reads = counted(spark, trades)
        run(source).write.format("noop").mode("overwrite").save()
        assert 0 < reads.value <= 2 * len(f)


def walked(starts, ends, days, cap, free, day, used):
    for s, e, d in zip(starts.tolist(), ends.tolist(), days.tolist(), strict=True):
        if s < free:
            continue
        if d != day:
            day, used = d, 0
        if cap and used >= cap:
            continue
        free, used = e, used + 1
    return free, day, used


@pytest.mark.parametrize("cap", [0, 1, 2, 5])
def test_pieces_against_a_walk(cap):
    rng = random.Random(cap)
    for _ in range(150):
        n = rng.randint(1, 40)
        starts = np.sort(np.array([rng.randint(0, 60) for _ in range(n)]))
        ends = starts + np.array([rng.randint(0, rng.choice((3, 40))) for _ in range(n)])
        order = np.lexsort((ends, starts))
        starts, ends = starts[order], ends[order]
        days = starts // rng.choice((5, 15, 100))
        cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(rng.randint(0, 4)))})
        parts = [steps.pieces_of(starts[a:b], ends[a:b], days[a:b], cap) for a, b in zip(cuts, cuts[1:], strict=False)]
        whole = steps.combined(parts) if len(parts) > 1 else parts[0]
        for _ in range(30):
            free = rng.randint(-1, 70)
            day, used = rng.choice([(steps.NEVER, 0), *([(int(days[0]), rng.randint(0, cap))] if cap else [])])
            got = steps.follow(whole, np.array([free]), np.array([day]), np.array([used]), np.zeros(1, bool))
            want = walked(starts, ends, days, cap, free, day, used)
            if not got[3][0]:
                assert want[0] == free
            else:
                assert got[0][0] == want[0]
                if cap:
                    assert (got[1][0], got[2][0]) == want[1:]


def test_late_exit_over_very_many_stretches(spark):
    """One trade stays open across nearly all of 10,000 stretches."""
    rows = spark.range(20_000).select(
        F.lit("A").alias("symbol"),
        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"),
        F.timestamp_seconds(F.when(F.col("id") == 3, 60 * 19_990).otherwise((F.col("id") + 1) * 60)).cast("timestamp_ntz").alias("exit_ts"),
        "id",
    )
    # Stretches of two rows, made directly: the cut itself would need as many shuffle partitions.
    parts = rows.select("symbol", (F.col("id") / 2).cast("long").alias("at"), (F.col("id") * 60).alias("s"), F.unix_seconds(F.col("exit_ts").cast("timestamp")).alias("e"))

    def solve(pdf):
        pdf = pdf.sort_values("s")
        out = pd.DataFrame(steps.pieces_of(pdf["s"].to_numpy(), pdf["e"].to_numpy(), pdf["s"].to_numpy() // 86_400, 0), columns=list(steps.PIECE))
        return out.assign(symbol="A", at=pdf["at"].iloc[0])[["symbol", "at", *steps.PIECE]]

    solved = parts.groupBy("symbol", "at").applyInPandas(solve, "symbol string, at long, " + ", ".join(f"{c} long" for c in steps.PIECE))
    before = steps.entry_states(cut_lineage(solved), [rows.schema["symbol"]]).toPandas().set_index("at")["free"]
    assert len(before) == 10_000 and before[0] == steps.NEVER
    assert (before[2:9995] == 60 * 19_990).all() and before[9999] == 60 * 19_998


def test_empty_tables(spark):
    empty = to_spark(spark, walk(5, 1)).limit(0).withColumn("exit_ts", F.col("ts")).withColumn("pnl", F.col("close"))
    assert K.non_overlapping(empty, max_per_day=2).count() == 0
    assert K.trade_equity(empty).count() == 0 and K.equity_curve(empty, empty).count() == 0
    assert K.compound_trades(empty.withColumnsRenamed({"open": "entry_price", "close": "exit_price"}), F.lit(0.1)).count() == 0


def test_written_steps_can_be_cleared(spark, bars):
    from pathlib import Path

    kept = cut_lineage(bars.limit(3))
    folder = Path(kept.inputFiles()[0].removeprefix("file:")).parents[1]
    assert folder.name == f"barspark-{spark.sparkContext.applicationId}" and folder.exists()
    clear_written(spark)
    assert not folder.exists()
