"""Training over folds: nothing of the test rows is used before they are scored."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.operators.fold_training import FoldSettings, train_over_folds
from barspark.operators.splits import fold_summary, ts_folds, walk_forward

ALL = {"colsample_bytree": 1.0, "colsample_bynode": 1.0, "subsample": 1.0}
FAST = FoldSettings(overrides={"n_estimators": 4, "max_depth": 2, "learning_rate": 0.3, **ALL}, mode="f1", scale_on=("train", "val"))


def rows(n=220, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    ts = pd.date_range("2024-01-01", periods=n, freq="h")
    return pd.DataFrame({"symbol": "A", "ts": ts, "a": x, "b": rng.exponential(size=n), "label": (x + rng.normal(0, 0.3, n) > 0).astype(int)})


def frame(spark, pdf):
    return spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, a double, b double, label int")


def test_folds_do_not_leak(spark):
    pdf = rows()
    spoiled = pdf.copy()
    # The last fold's test rows: other values and labels there change its test metrics only.
    spoiled.loc[180:, ["a", "b"]] = 1e6
    spoiled.loc[180:, "label"] = 1
    runs = []
    for p in (pdf, spoiled):
        run = train_over_folds(walk_forward(frame(spark, p), 100, 40, 40, inner=0.7), FAST, cols=["a", "b"])
        runs.append((run.metrics.orderBy("fold").toPandas(), run.scales.orderBy("fold", "pos").toPandas(), run.scored.count()))
    (m, s, n), (m2, s2, _) = runs
    assert list(m.fold) == [0, 1, 2] and set(m.state) == {"trained"} and n == 120
    pd.testing.assert_frame_equal(s, s2)
    assert list(m.threshold) == list(m2.threshold)
    pd.testing.assert_frame_equal(m.iloc[:2], m2.iloc[:2])
    assert m2.positives_test.iloc[2] == 40 != m.positives_test.iloc[2]
    assert (m.tp + m.fn == m.positives_test).all() and (m.tp + m.fp + m.tn + m.fn == m.n_test).all()
    assert m.roc_auc.mean() > 0.8
    for k in range(3):
        part = pdf.iloc[k * 40 : k * 40 + 100]
        q = part[["a", "b"]].quantile([0.25, 0.5, 0.75]).to_numpy()
        assert np.allclose(s[s.fold == k].center, q[1]) and np.allclose(s[s.fold == k].scale, q[2] - q[0])


def test_folds_that_cannot_be_trained(spark):
    pdf = rows(120)
    pdf.loc[:39, "label"] = 0
    run = train_over_folds(ts_folds(frame(spark, pdf), 3, halves=True), FAST, cols=["a", "b"])
    m = run.metrics.orderBy("fold").toPandas()
    assert list(m.state) == ["one class", "trained", "trained"]
    assert m.loc[0, ["tp", "threshold", "f1"]].isna().all() and m.n_train.tolist() == [30, 60, 90]
    assert fold_summary(run.metrics, ["f1"]).first()["mean"] == pytest.approx(m.f1.mean())
    # Without val rows the given threshold holds; rows without label or fold take no part.
    odd = walk_forward(frame(spark, rows(140)), 100, 40, 40)
    odd = odd.unionByName(odd.limit(3).withColumn("label", F.lit(None).cast("int"))).unionByName(odd.limit(2).withColumn("fold", F.lit(None).cast("long")))
    one = train_over_folds(odd, FAST, cols=["a", "b"]).metrics.first()
    assert (one["threshold"], one["n_train"], one["n_val"], one["n_test"]) == (0.5, 100, 0, 40)


def test_no_folds(spark):
    run = train_over_folds(walk_forward(frame(spark, rows(20)), 100, 40, 40), FAST, cols=["a", "b"])
    assert run.metrics.count() == run.scored.count() == run.scales.count() == 0
