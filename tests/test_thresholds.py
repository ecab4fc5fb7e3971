"""Sweep, choices and evaluation against a loop over thresholds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from barspark.operators import threshold as T
from tests.conftest import to_spark

CAP = 4


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(11)
    n = 900
    p = np.round(rng.beta(2, 3, n), 6)
    f = pd.DataFrame(
        {
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(60 * 24 * 40, n, replace=False)), unit="min"),
            "probability": p,
            "label": (rng.random(n) < p).astype(int),
        }
    )
    return to_spark(spark, f).cache(), f


def capped(f: pd.DataFrame, t: float, cap: int | None) -> pd.DataFrame:
    hit = f[f.probability >= t]
    if not cap:
        return hit
    ranked = hit.sort_values(["probability", "ts"], ascending=[False, True])
    return ranked.groupby(ranked.ts.dt.date).head(cap)


@pytest.mark.parametrize("cap", [None, CAP])
def test_sweep_by_loop(scored, cap):
    df, f = scored
    grid = T.candidate_thresholds(df, 51)
    got = T.sweep(df, grid, cap).toPandas()
    want = np.unique(np.clip(np.quantile(f.probability, np.linspace(0, 1, 51)), 0.001, 0.99))
    assert np.allclose(np.sort(got.threshold), np.unique(np.concatenate([[0.001], want, [0.99]])))
    for r in got.itertuples():
        picked = capped(f, r.threshold, cap)
        assert (r.trades, r.tp) == (len(picked), picked.label.sum())


def test_choices_by_loop(scored):
    df, f = scored
    table = T.sweep(df, T.candidate_thresholds(df, 101), CAP, payoff=T.Payoff(2.0, -1.0))
    t = table.toPandas()
    ok = t[(t.trades >= 10) & (t.precision >= 0.5) & (t.recall >= 0.1)]
    best = ok.ev_total.max()
    got = T.pick_hybrid(table, 0.5, 0.1).first()
    assert got["tier"] == 0 and got["ev_total"] == pytest.approx(best)
    none = T.pick_ev(table, min_trades=10**6).first()
    assert none["threshold"] == 0.5 and none["trades"] is None
    low = T.pick_hybrid(table, 0.0, 0.99, recall_bound=T.max_recall(df, CAP)).first()
    assert low["tier"] in (0, 1)


@pytest.mark.parametrize("mode", ["hybrid", "ev", "f1"])
def test_evaluate_raises_threshold_to_the_selected(scored, mode):
    df, f = scored
    row = T.evaluate(df, mode=mode, cap=CAP, min_precision=0.4).first()
    chosen = capped(f, row["threshold"], CAP)
    assert row["trades"] == len(chosen) and row["threshold"] == chosen.probability.min()
    assert row["precision"] == pytest.approx(chosen.label.mean())


def test_ranking_by_pairs(scored):
    df, f = scored
    pos, neg = f[f.label == 1].probability.to_numpy(), f[f.label == 0].probability.to_numpy()
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert T.ranking_quality(df).first()["roc_auc"] == pytest.approx(auc)
    one = T.ranking_quality(df.where("label = 1")).first()
    assert one["roc_auc"] is None and one["pr_auc"] is None
