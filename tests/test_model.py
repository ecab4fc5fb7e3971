"""Scaling, weights, trees, artifacts and the whole run."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.operators import model as M
from barspark.operators.features import FeatureFlags
from barspark.operators.sequences import sequence_names
from barspark.operators.threshold import ranking_quality
from barspark.operators.training import TrainSettings, train_and_evaluate
from tests.conftest import to_spark, walk


def vectors(spark, n=400, seed=0, shuffled=False):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(5, 3, n), rng.exponential(2, n), (rng.random(n) < 0.1).astype(float)])
    y = (x[:, 0] + rng.normal(0, 1, n) > 5).astype(int)
    if shuffled:
        y = rng.permutation(y)
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "i int, features array<double>, label int"), x, y


def test_robust_scale(spark):
    df, x, _ = vectors(spark)
    got = np.array([r["features"] for r in M.RobustScale.fit(df).apply(df).orderBy("i").collect()])
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    scale = np.where(q3 > q1, q3 - q1, 1.0)
    assert np.allclose(got, (x - q2) / scale)
    assert set(np.unique(got[:, 2])) == {0.0, 1.0}
    rough = M.RobustScale.fit(df, accuracy=1000).apply(df).orderBy("i").first()["features"]
    assert np.allclose(rough, got[0], atol=0.1)


def test_weights(spark):
    df, _, y = vectors(spark)
    row = M.with_weights(df).where("label = 1").first()
    assert row["weight"] == pytest.approx((y == 0).sum() / y.sum())
    assert M.with_weights(df, positive=3.0).where("label = 1").first()["weight"] == 3.0


def test_profiles():
    p = M.tree_params("conservative", {"max_depth": 5, "subsample": None})
    assert p["max_depth"] == 5 and p["subsample"] == 0.5
    with pytest.raises(ValueError):
        M.tree_params("nope")


def test_trees_learn_and_repeat(spark):
    fast = {"n_estimators": 8, "max_depth": 3, "learning_rate": 0.3}
    df, _, _ = vectors(spark)
    new, _, _ = vectors(spark, seed=1)
    noise, _, _ = vectors(spark, shuffled=True)

    def auc(train):
        rows = train.withColumn("v", F.col("i") % 5 == 0)
        return ranking_quality(M.score(new, M.train_gbt(rows, validation="v", overrides=fast))).first()["roc_auc"]

    first = auc(df)
    assert first == auc(df) and first > 0.8 > auc(noise)


def test_scores_floor_and_report(spark, tmp_path):
    df, _, _ = vectors(spark)
    model = M.train_gbt(df, overrides={"n_estimators": 3, "max_depth": 2})
    out = M.score(df, model, 0.4, floor=0.6)
    assert out.where("prediction <> CAST(probability >= 0.6 AS INT)").count() == 0
    table = M.importance_table(model, ["a", "b", "c"], 1, spark)
    rep = M.importance_report(table, 2)
    assert [r["name"] for r in table.collect()] == sequence_names(["a", "b", "c"], 1) and rep["top"].count() == 2
    assert rep["by_feature"].agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert M.compare_importance(table, table).where("NOT matches").count() == 0
    record = M.metadata(["a", "b", "c"], 80, 0.61, 0.4, max_trades_per_day=150, note=None)
    assert record["total_features"] == 240 and record["recommended_min_candles_m1"] == 1400 and "note" not in record
    M.save_model(spark, model, M.RobustScale.fit(df), record, ["a", "b", "c"], str(tmp_path / "m"))
    again, scaler, meta, cols = M.load_model(spark, str(tmp_path / "m"))
    assert meta == record and cols == ["a", "b", "c"] and scaler.apply(df).count() == df.count()
    assert M.score(df, again).orderBy("i").first()["probability"] == M.score(df, model).orderBy("i").first()["probability"]


def test_whole_run_and_latest_score(spark):
    f = pd.concat([walk(1600, s, minutes=5, symbol=k) for s, k in ((1, "A"), (2, "B"))])
    settings = TrainSettings(
        window=5, horizon=20, mode="f1", overrides={"n_estimators": 3, "max_depth": 2}, session="all", max_windows=None
    )
    flags = FeatureFlags(obv=False, cvd=False, macd=False)
    bars = to_spark(spark, f)
    run = train_and_evaluate(bars, settings, flags, rolled=True)
    row = run.metrics.first()
    assert row["tp"] + row["fp"] == row["trades"] and 0 <= row["roc_auc"] <= 1
    parts = {r["split"]: (r["a"], r["b"]) for r in run.scored.where("symbol = 'A'").groupBy("split").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()}
    assert parts["train"][1] < parts["val"][0] and parts["val"][1] < parts["test"][0]
    record = M.metadata(run.columns, settings.window, run.threshold, 0.4)
    out = M.score_latest(bars, run.model, run.scaler, record, run.columns, flags=flags, gate=True)
    rows = {r["symbol"]: r for r in out.collect()}
    assert set(rows) == {"A", "B"} and rows["A"]["ts"] == f[f.symbol == "A"].ts.max()
    assert rows["A"]["regime"].startswith("TIER")
