"""Quantiles of vector positions by refined histograms, against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.operators.model import RobustScale
from barspark.plans.select import from_bits, ordered_bits, vector_quantiles

PROBS = [0.0, 0.25, 0.5, 0.77, 1.0]


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.0, -1e-310, 0.0, 1e-310, 1.0, 1.0 + 2e-16, 1e300, np.inf])
    bits = ordered_bits(x)
    assert (bits[1:] > bits[:-1]).all() and np.array_equal(from_bits(bits), x)
    assert ordered_bits(np.array([-0.0]))[0] == ordered_bits(np.array([0.0]))[0]


@pytest.mark.parametrize("parts", [1, 7])
def test_against_numpy(spark, parts):
    rng = np.random.default_rng(3)
    x = np.column_stack((rng.normal(0, 1, 500), rng.normal(1e6, 1e-3, 500), rng.integers(-2, 3, 500), np.full(500, 7.5), -np.exp(rng.normal(0, 50, 500))))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(parts)
    assert np.array_equal(vector_quantiles(df, "v", PROBS), np.quantile(x, PROBS, axis=0, method="linear").T) or np.allclose(
        vector_quantiles(df, "v", PROBS), np.quantile(x, PROBS, axis=0).T, rtol=1e-15
    )


def test_holes_short_rows_and_nothing(spark):
    rows = [([1.0, None, float("nan")],), ([3.0, 2.0],), (None,), ([],), ([8.0, 4.0],)]
    got = vector_quantiles(spark.createDataFrame(rows, "v array<double>"), "v", [0.5])
    assert got[:2, 0].tolist() == [3.0, 3.0] and np.isnan(got[2, 0])
    assert vector_quantiles(spark.createDataFrame([], "v array<double>"), "v", [0.5]).shape == (0, 1)


def test_many_positions_without_a_row_per_value(spark):
    """2,880 positions as of 80 bars of 36 columns: nothing is exploded in the plan of the scaler."""
    df = spark.range(300).select(F.transform(F.sequence(F.lit(1), F.lit(2880)), lambda k: F.sin(k * (F.col("id") + 1)) * k).alias("features"))
    x = np.sin(np.outer(np.arange(300) + 1, np.arange(1, 2881))) * np.arange(1, 2881)
    s = RobustScale.fit(df).stats.first()["s"]
    assert np.allclose(s["center"], np.median(x, axis=0), atol=1e-9)
    assert np.allclose(s["scale"], np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0), atol=1e-9)
