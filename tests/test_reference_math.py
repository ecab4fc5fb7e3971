"""Indicators against straightforward pandas formulas, and the golden rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.functions import indicators as I
from barspark.functions import sizing as Z
from barspark.functions.regime import classify_regime, should_trade
from barspark.operators import features as FT
from barspark.operators import labels as L
from barspark.operators import metrics as M
from tests.conftest import same, to_pandas, to_spark, walk


@pytest.fixture(scope="module")
def frame():
    return walk(1500, 5, minutes=5)


@pytest.fixture(scope="module")
def bars(spark, frame):
    return to_spark(spark, frame).cache()


def roll(s: pd.Series, n: int):
    return s.rolling(n, min_periods=1)


def true_range(f: pd.DataFrame) -> pd.Series:
    pc = f.close.shift(1)
    out = np.maximum(f.high - f.low, np.maximum((f.high - pc).abs(), (f.low - pc).abs()))
    return pd.Series(out).where(pc.notna())


def test_rsi_atr_bollinger(bars, frame):
    d = frame.close.diff()
    up, down = roll(d.clip(lower=0), 14).mean(), roll(-d.clip(upper=0), 14).mean()
    want = 100 - 100 / (1 + up / down.where(down != 0))
    got = to_pandas(I.rsi(bars, "close", 14, out="x"))["x"]
    same(pd.DataFrame({"x": got}), pd.DataFrame({"x": want}), ["x"])
    atr = roll(true_range(frame), 14).mean()
    same(to_pandas(I.atr(bars, 14, out="x")), pd.DataFrame({"x": atr}), ["x"])
    mid, sd = roll(frame.close, 20).mean(), roll(frame.close, 20).std()
    out = to_pandas(I.bollinger(bars, "close", 20, out=("u", "m", "l")))
    same(out, pd.DataFrame({"u": mid + 2 * sd, "m": mid, "l": mid - 2 * sd}), ["u", "m", "l"])


def test_adx(bars, frame):
    up, fall = frame.high.diff(), -frame.low.diff()
    plus = up.where((up > fall) & (up > 0), 0.0)
    minus = fall.where((fall > up) & (fall > 0), 0.0)
    tr = roll(true_range(frame), 14).mean()
    p, m = 100 * roll(plus, 14).mean() / (tr + 1e-9), 100 * roll(minus, 14).mean() / (tr + 1e-9)
    dx = 100 * (p - m).abs() / (p + m + 1e-9)
    want = pd.DataFrame({"a": roll(dx, 14).mean(), "p": p, "m": m})
    same(to_pandas(I.adx(bars, 14, out=("a", "p", "m"))), want, ["a", "p", "m"])


def test_new_high_divergence_by_loop(bars, frame):
    c, v = frame.close.to_numpy(), frame.volume.to_numpy()
    new = c == roll(frame.close, 20).max().to_numpy()
    want = np.zeros(len(c), int)
    for i in range(len(c)):
        earlier = [j for j in range(max(0, i - 20), i) if new[j]]
        if new[i] and earlier and v[i] < v[earlier[-1]]:
            want[i] = 1
    got = to_pandas(I.new_high_volume_divergence(bars, 20, out="x"))["x"].to_numpy()
    assert (got == want).all() and want.sum() > 0


def test_feature_columns(bars):
    out = FT.m5_features(bars, rolled=True, align="open")
    assert [c for c in out.columns if c in FT.M5_COLUMNS] == [c for c in FT.M5_COLUMNS if c not in ("mfi_m15", "mfi_m60")]
    assert len([c for c in out.columns if c in FT.M5_COLUMNS]) == 36
    assert out.where(" OR ".join(f"{c} IS NULL" for c in FT.M5_COLUMNS if c in out.columns)).count() == 0
    one = FT.m1_features(bars, widths=("15 minutes", "1 hour", "4 hours"), fine_width="5 minutes")
    assert [c for c in one.columns if c not in ("symbol", "ts")] == FT.M1_COLUMNS


def test_close_alignment_sees_no_later_bar(spark, frame):
    """Changing bars after a moment changes no feature up to it."""
    cut = frame.ts.iloc[900]
    later = frame.copy()
    later.loc[later.ts > cut, ["open", "high", "low", "close", "volume"]] *= 1.7
    kw = dict(rolled=True, flags=FT.FeatureFlags(m60_context=True))
    a, b = (to_pandas(FT.m5_features(to_spark(spark, f), **kw)) for f in (frame, later))
    cols = [c for c in a.columns if c in FT.M5_COLUMNS]
    same(a[a.ts <= cut], b[b.ts <= cut], cols)


def test_tie_is_loss(spark):
    f = pd.DataFrame(
        {
            "symbol": "A",
            "ts": pd.date_range("2025-12-01", periods=5, freq="5min"),
            "open": [100.0, 100, 101, 102, 103],
            "high": [100.0, 102, 103, 104, 105],
            "low": [100.0, 99, 100, 101, 102],
            "close": [100.0, 100, 102, 103, 104],
            "volume": 1.0,
            "atr_m5": 1.0,
        }
    )
    out = to_pandas(L.barrier_label(to_spark(spark, f), 1, 2, 1, 2))
    assert out["label"].iloc[0] == 0 and len(out) == 3


def test_target_hit(spark):
    close = np.array([102.0, 104.5, 103.5, 104, 104.2, 104.5])
    f = pd.DataFrame(
        {
            "symbol": "A",
            "ts": pd.date_range("2024-01-01", periods=6, freq="1min"),
            "open": close,
            "high": close + 3,
            "low": close - 0.25,
            "close": close,
            "volume": 1.0,
            "atr_m5": 1.0,
        }
    )
    assert to_pandas(L.barrier_label(to_spark(spark, f), 1, 2, 1, 3))["label"].iloc[0] == 1


@pytest.mark.parametrize("args", [(0, 1, 1, 2), (1, -1, 1, 2), (1, 1, 0, 2), (1, 1, 3, 2)])
def test_label_checks(bars, args):
    with pytest.raises(ValueError):
        L.barrier_label(bars, *args)
    with pytest.raises(ValueError):
        L.require_labels(L.barrier_label(bars.limit(3), 1, 2, 1, 50))


def test_trade_metrics(spark):
    t = spark.createDataFrame([("s", float(x)) for x in (100, -50, 150, -30, 200, -80, 120)], "symbol string, pnl double")
    assert M.win_rate(t).first()["win_rate"] == pytest.approx(4 / 7)
    assert M.profit_factor(t).first()["profit_factor"] == pytest.approx(570 / 160)
    only = M.profit_factor(t.where("pnl > 0")).first()
    assert only["profit_factor"] is None and only["no_losses"]


def _equity(spark, values):
    rows = [("s", i, datetime(2024, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, seq long, ts timestamp_ntz, equity double")


def test_flat_and_rising_equity(spark):
    rising = M.max_drawdown(_equity(spark, [1, 2, 3, 4])).first()
    assert rising["max_drawdown"] == 0 and rising["peak_ts"] is None and rising["trough_ts"] is None
    flat = M.returns(_equity(spark, [5, 5, 5, 5]))
    assert M.sharpe_ratio(flat).first()["sharpe_ratio"] is None
    dip = M.max_drawdown(_equity(spark, [100, 110, 90, 95])).first()
    assert dip["max_drawdown"] == pytest.approx(20 / 110)
    assert (dip["peak_ts"].day, dip["trough_ts"].day) == (2, 3)
    with pytest.raises(ValueError):
        M.check_equity(_equity(spark, [1, -1]))


def test_costs_and_pips(spark):
    assert Z.transaction_cost(0.5, 0.3, 5.0) == pytest.approx(5.8)
    row = spark.range(1).select(Z.pip_value(F.lit(0.01)).alias("a"), Z.pip_value(F.lit(1.0)).alias("b")).first()
    assert (row["a"], row["b"]) == (1.0, 100.0)
    with pytest.raises(ValueError):
        Z.pip_value(F.lit(1.0), "EURUSD")
    with pytest.raises(ValueError):
        Z.position_size("martingale", capital=F.lit(1.0))


def test_regime_points(spark):
    points = [(9.0, 10.0, 2620.0, 2618.0), (8.0, 8.0, 2615.0, 2620.0), (13.0, 12.0, 2635.0, 2625.0), (20.0, 20.0, 2650.0, 2620.0), (16.0, 16.0, 2640.0, 2620.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, atr double, adx double, price double, sma double")
    cols = [F.col(c) for c in ("atr", "adx", "price", "sma")]
    rows = df.select("i", classify_regime(*cols).alias("c"), should_trade(*cols).alias("t")).orderBy("i").collect()
    assert [int(r["c"]["regime"][4]) for r in rows] == [3, 3, 2, 1, 2]
    assert [r["t"]["allowed"] for r in rows] == [True, False, True, True, True]
    assert rows[1]["t"]["reason"].endswith("Not uptrend (dist -5.0 < 0.0)")
    bad = spark.range(1).select(classify_regime(F.lit(0.0), F.lit(5.0), F.lit(1.0), F.lit(1.0)).alias("c")).first()["c"]
    assert bad["regime"].startswith("TIER4") and not bad["in_uptrend"]


def test_minimal_set_by_pandas(bars, frame):
    r = np.log(frame.close).diff()
    want = pd.DataFrame({"ts": frame.ts, "vol_60": r.rolling(60).std(), "mom_30": r.rolling(30).mean()}).dropna()
    got = to_pandas(FT.minimal_features(bars))
    both = got.merge(want, on="ts", suffixes=("", "_w"))
    assert len(both) == len(got) >= 1300
    assert np.abs(both.vol_60 - both.vol_60_w).max() < 1e-12 and np.abs(both.mom_30 - both.mom_30_w).max() < 1e-12
