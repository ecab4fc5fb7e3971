"""Chunked plans give the rows of the plain ones, also when one key holds most rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.functions import indicators as I
from barspark.operators import features as FT
from barspark.operators.labels import barrier_label
from barspark.operators.sequences import sequence
from barspark.plans.chunks import chunked_rows, with_row_index
from barspark.plans.scan import exact_quantiles, running, value_scan
from barspark.plans.series import cut_series
from tests.conftest import same, to_pandas, to_spark, walk


@pytest.fixture(scope="module")
def bars(spark):
    hot = walk(4000, 1, minutes=15, symbol="HOT")
    cold = walk(500, 2, minutes=30, symbol="COLD")
    return to_spark(spark, pd.concat([hot, cold])).cache()


@pytest.mark.parametrize("rows", [37, 400, 5000])
@pytest.mark.parametrize("reach", [(0, 0), (1, 0), (150, 0), (0, 90), (60, 60)])
def test_halo_covers_every_frame(bars, rows, reach):
    back, ahead = reach
    cut = chunked_rows(bars, back=back, ahead=ahead, chunk_rows=rows)
    frame = cut.line.between(-back, ahead)
    got = cut.trim(cut.df.withColumn("s", F.sum("close").over(frame)).withColumn("n", F.count("close").over(frame)))
    plain = chunked_rows(bars, back=back, ahead=ahead, chunk_rows=0)
    want = plain.df.withColumn("s", F.sum("close").over(plain.line.between(-back, ahead))).withColumn(
        "n", F.count("close").over(plain.line.between(-back, ahead))
    )
    same(to_pandas(got), to_pandas(want), ["s", "n"])


def test_chunks_stay_small(bars):
    cut = chunked_rows(bars, back=50, chunk_rows=300)
    sizes = cut.df.groupBy("symbol", "_chunk").count().agg(F.max("count")).first()[0]
    # A chunk, a day of slack, and a halo rounded up to whole days.
    assert sizes <= 300 + 96 + 50 + 96


def test_row_index(bars):
    a = to_pandas(with_row_index(bars))
    w = Window.partitionBy("symbol")
    b = to_pandas(bars.withColumn("idx", F.row_number().over(w.orderBy("ts")) - 1).withColumn("n", F.count("*").over(w)))
    assert (a["idx"] == b["idx"]).all() and (a["n"] == b["n"]).all()


def test_running_kinds(bars):
    holes = bars.withColumn("x", F.when(F.col("volume") % 3 == 0, F.col("close")))
    spec = {"total": ("sum", "volume"), "top": ("max", "close"), "low": ("min", "close"), "seen": ("last", "x")}
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    kinds = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    want = to_pandas(holes.withColumns({out: kinds[kind](c).over(w) for out, (kind, c) in spec.items()}))
    same(to_pandas(running(holes, spec)), want, list(spec))
    same(to_pandas(cut_series(holes, part_rows=64).running(spec).rows), want, list(spec))


def test_feature_sets_equal(bars):
    kw = dict(fine="15 minutes", mid="1 hour", slow="4 hours", rolled=True, flags=FT.FeatureFlags(mfi=True, m60_context=True))
    a, b = (to_pandas(FT.m5_features(bars, chunk_rows=r, **kw)) for r in (700, 0))
    same(a, b, [c for c in FT.M5_COLUMNS if c in a.columns], 1e-6)


def test_labels_and_sequences_equal(bars):
    a, b = (to_pandas(barrier_label(bars, 1, 2, 2, 40, chunk_rows=r)) for r in (55, 0))
    assert (a["label"] == b["label"]).all() and len(a) == len(b)
    a, b = (to_pandas(sequence(bars, ["close"], 30, chunk_rows=r)) for r in (55, 0))
    assert np.array_equal(np.stack(a["features"]), np.stack(b["features"]))


def test_ema_is_the_recursion(bars):
    out = to_pandas(I.macd(bars, "close", out=("line", "signal", "hist"), chunk_rows=900))
    for _, part in out.groupby("symbol"):
        c = part["close"]
        line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        sig = line.ewm(span=9, adjust=False).mean()
        assert np.abs(part["line"] - line).max() < 1e-9
        assert np.abs(part["signal"] - sig).max() < 1e-9


def test_quantiles_with_hot_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 1.5).alias("v"), (F.col("id") % 2).alias("k"))
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, "v", probs, keys=["k"]).toPandas()
    data = df.toPandas()
    for _, r in got.iterrows():
        assert abs(np.quantile(data[data.k == r.k].v, r.prob) - r.q) < 1e-9
    assert len(got) == 2 * len(probs)


def test_value_scan_ranges(spark):
    df = spark.range(2000).select((F.hash("id") % 500).cast("double").alias("v"), F.lit(1).alias("one"))
    got = to_pandas(value_scan(df, "v", ["one"]), "v")
    assert (got["one_below"] == got["one"].cumsum() - got["one"]).all() and got["one"].sum() == 2000
