"""One position at a time, first exits and equity against plain loops."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.operators import trades as K
from barspark.operators.labels import first_exit, mark_open, scan_outcome, verify_exits
from tests.conftest import to_pandas, to_spark, walk


def loop(frame: pd.DataFrame, cap: int | None) -> list:
    taken = []
    for sym, part in frame.sort_values("ts").groupby("symbol"):
        free, day, used = None, None, 0
        for r in part.itertuples():
            if r.ts.date() != day:
                day, used = r.ts.date(), 0
            if free is not None and r.ts < free:
                continue
            if cap is not None and used >= cap:
                continue
            taken.append((sym, r.ts))
            free, used = r.exit_ts, used + 1
    return sorted(taken)


def signals(seed: int, n: int = 600, longest: int = 400) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    out = []
    for sym in ("A", "B"):
        at = np.sort(rng.choice(20 * 24 * 60, n, replace=False))
        ts = pd.Timestamp("2024-03-01") + pd.to_timedelta(at, unit="min")
        out.append(pd.DataFrame({"symbol": sym, "ts": ts, "exit_ts": ts + pd.to_timedelta(rng.integers(1, longest, n), unit="min")}))
    return pd.concat(out)


@pytest.mark.parametrize("cap", [None, 1, 3])
@pytest.mark.parametrize("rows", [0, 20, 90])
@pytest.mark.parametrize("longest", [30, 400, 5000])
def test_non_overlapping(spark, cap, rows, longest):
    f = signals(longest + (cap or 0), longest=longest)
    got = K.non_overlapping(to_spark(spark, f), max_per_day=cap, chunk_rows=rows).toPandas()
    assert sorted(zip(got.symbol, got.ts, strict=True)) == loop(f, cap)


def test_small_example(spark):
    day = pd.Timestamp("2024-01-01")
    f = pd.DataFrame([("A", day + pd.Timedelta(hours=a), day + pd.Timedelta(hours=b)) for a, b in ((1, 5), (2, 3), (5, 9), (8, 10), (9, 12))], columns=["symbol", "ts", "exit_ts"])
    got = K.non_overlapping(to_spark(spark, f)).toPandas()
    assert sorted(t.hour for t in got.ts) == [1, 5, 9]


@pytest.fixture(scope="module")
def market():
    return walk(3000, 9, start="2023-12-30", minutes=60)


def exits_by_loop(frame, sl, tp, tie):
    o, h, lo = frame.open.to_numpy(), frame.high.to_numpy(), frame.low.to_numpy()
    out = []
    for i in range(len(frame)):
        for j in range(i + 1, len(frame)):
            s, t = lo[j] <= sl[i], h[j] >= tp[i]
            if s or t:
                both = {"loss": False, "tp_first": True, "near_open": abs(o[j] - tp[i]) < abs(o[j] - sl[i])}[tie]
                out.append((frame.ts.iloc[i], frame.ts.iloc[j], both if s and t else bool(t)))
                break
    return out


@pytest.mark.parametrize("tie", ["loss", "near_open", "tp_first"])
def test_first_exit(spark, market, tie):
    f = market.assign(atr=2.5)
    entries = to_spark(spark, f[["symbol", "ts", "close", "atr"]])
    got = to_pandas(first_exit(entries, to_spark(spark, market), sl=1.0, tp=1.8, tie=tie), "ts")
    want = exits_by_loop(market, (f.close - 2.5).to_numpy(), (f.close + 4.5).to_numpy(), tie)
    assert list(zip(got.ts, got.exit_ts, got.is_win, strict=True)) == want
    assert (got.exit_ts - got.ts).max() > pd.Timedelta(days=1)


def test_far_exit_crosses_years(spark):
    """A level first reached years later is found through the year, month and day blocks."""
    ts = pd.date_range("2015-01-01", "2023-12-31", freq="1D")
    close = np.full(len(ts), 100.0)
    close[-40] = 111.0
    f = pd.DataFrame({"symbol": "A", "ts": ts, "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": 1.0})
    e = f.iloc[[5]][["symbol", "ts"]].assign(sl_price=50.0, tp_price=110.0)
    got = first_exit(to_spark(spark, e), to_spark(spark, f)).first()
    assert got["exit_ts"] == ts[-40] and got["is_win"]
    never = first_exit(to_spark(spark, e.assign(tp_price=500.0)), to_spark(spark, f), keep_open=True).first()
    assert never["exit_ts"] is None and never["exit_price"] is None


def test_scan_outcome_edges(spark, market):
    f = market.tail(40)
    s = f[["symbol", "ts"]].assign(atr=[0.0] + [2.0] * 39)
    got = to_pandas(scan_outcome(to_spark(spark, s), to_spark(spark, f), min_hold=2, horizon=10), "ts")
    assert got.outcome.iloc[0] == "InvalidATR" and got.outcome.iloc[-1] == "Pending"
    assert got.profit_loss.iloc[[0, -1]].isna().all()
    assert set(got.outcome) >= {"Timeout"} or set(got.outcome) >= {"Win"}


def test_mark_open_states(spark, market):
    f = market.head(200)
    e = f.iloc[[10, 150]][["symbol", "ts", "close"]].rename(columns={"close": "entry_price"}).assign(sl_price=0.1, tp_price=1e9)
    got = to_pandas(mark_open(to_spark(spark, e), to_spark(spark, f), str(f.ts.iloc[160]), min_hold=2, horizon=30), "ts")
    assert list(got.outcome) == ["Timeout", "Pending"]
    assert got.exit_ts.iloc[0] == f.ts.iloc[40] and got.exit_ts.iloc[1] == f.ts.iloc[160]


def test_verify_exits_flags_a_wrong_time(spark, market):
    e = market.iloc[[50]][["symbol", "ts", "close"]].assign(sl_price=lambda x: x.close - 2, tp_price=lambda x: x.close + 2)
    bars = to_spark(spark, market)
    true = first_exit(to_spark(spark, e), bars, tie="loss").first()
    for shift, ok in ((0, True), (1, False)):
        listed = e.assign(expected_exit_ts=true["exit_ts"] + pd.Timedelta(hours=shift), expected_win=true["is_win"])
        assert verify_exits(to_spark(spark, listed), bars).first()["matches"] is ok


def test_equity_follows_the_engine(spark, market):
    """Equity points and the daily cap as a sequential run records them."""
    f = market.head(900).assign(probability=0.6, prediction=(np.arange(900)[: len(market.head(900))] % 7 == 0).astype(int), atr=2.0)
    p = to_spark(spark, f[["symbol", "ts", "close", "atr", "probability", "prediction"]])
    bars = to_spark(spark, market)
    trades = K.take_trades(p, bars, max_per_day=2)
    eq = to_pandas(K.equity_curve(p, trades, 1000.0), "seq")
    hit = {a: (b, w) for a, b, w in exits_by_loop(market, (market.close - 2).to_numpy(), (market.close + 3.6).to_numpy(), "near_open")}
    capital, free, day, used, want = 1000.0, None, None, 0, [1000.0]
    for r in f.itertuples():
        if r.ts.date() != day:
            day, used = r.ts.date(), 0
        if free is not None and r.ts < free:
            continue
        if r.prediction == 1 and used < 2 and r.ts in hit:
            end, win = hit[r.ts]
            capital += 0.01 * (3.6 if win else -2.0) - 0.8
            free, used = end, used + 1
        want.append(capital)
    assert np.allclose(eq.equity, want)


def test_drawdown_stop_keeps_the_breach(spark):
    rows = [("s", i, datetime(2024, 1, 1) + timedelta(days=i), v) for i, v in enumerate([100.0, 120.0, 90.0, 200.0])]
    eq = spark.createDataFrame(rows, "symbol string, seq long, ts timestamp_ntz, equity double")
    for rows_ in (0, 1):
        assert sorted(r["seq"] for r in K.drawdown_stop(eq, 0.2, chunk_rows=rows_).collect()) == [0, 1, 2]


def test_sizes_follow_the_capital_until_it_is_lost(spark):
    moves = [5.0, -3.0, 10.0, -200.0, 7.0]
    rows = [("A", f"2024-01-0{k + 1} 10:00", 100.0, 100.0 + m) for k, m in enumerate(moves)]
    trades = spark.createDataFrame(rows, "symbol string, at string, entry_price double, exit_price double")
    trades = trades.select("symbol", F.to_timestamp_ntz("at", F.lit("yyyy-MM-dd HH:mm")).alias("ts"), "entry_price", "exit_price")
    for chunk in (0, 1):
        got = K.compound_trades(trades, F.lit(0.01), 1000.0, cost=2.0, chunk_rows=chunk).orderBy("ts").collect()
        capital, want = 1000.0, []
        for m in moves:
            lost = 1 + 0.01 * m <= 0
            want.append(capital)  # the trade that takes the rest is the last one
            capital = 0.0 if lost or capital == 0 else max(0.0, capital * (1 + 0.01 * m) - 2.0)
        assert [round(r["capital"], 8) for r in got] == [round(c, 8) for c in want]
        assert [round(r["pnl"], 8) for r in got][:2] == [round(1000 * 0.05 - 2, 8), round(want[1] * -0.03 - 2, 8)]


def _compounded(spark, moves, initial, cost, chunk):
    rows = [("A", k, 100.0, 100.0 + m) for k, m in enumerate(moves)]
    trades = spark.createDataFrame(rows, "symbol string, k long, entry_price double, exit_price double")
    trades = trades.withColumn("ts", F.timestamp_seconds(F.col("k") * 60).cast("timestamp_ntz"))
    return K.compound_trades(trades, F.lit(0.01), initial, cost=cost, chunk_rows=chunk).orderBy("ts").collect()


@pytest.mark.parametrize("chunk", [None, 3])
def test_costs_alone_take_the_capital(spark, chunk):
    got = _compounded(spark, [0.0] * 5, 10.0, 5.8, chunk)
    assert [round(r["capital"], 9) for r in got] == [10.0, 4.2, 0.0, 0.0, 0.0]
    assert [round(r["pnl"], 9) for r in got] == [-5.8, -4.2, 0.0, 0.0, 0.0]
    assert all(r["position_size"] >= 0 for r in got)


@pytest.mark.parametrize(("move", "cost"), [(-50.0, 0.0), (-50.0, 1.0), (100.0, 1.0), (300.0, 0.0)])
def test_long_runs_are_never_nan(spark, move, cost):
    """Thousands of losing or winning trades: capital against the plain recursion, null beyond the range of a double."""
    capital = 1000.0
    for r in _compounded(spark, [move] * 2000, 1000.0, cost, 300):
        if capital == float("inf"):
            assert r["capital"] is None
        else:
            assert r["capital"] == pytest.approx(capital, rel=1e-9, abs=1e-300)
        assert all(r[c] is None or abs(r[c]) < float("inf") for c in ("capital", "position_size", "gross_pnl", "pnl"))
        capital = max(0.0, capital * (1 + 0.01 * move) - cost) if capital > 0 else 0.0


def test_mixed_run_against_the_recursion(spark):
    rng = np.random.default_rng(4)
    moves = rng.normal(0, 4, 500).tolist()
    capital = 50.0
    for r, m in zip(_compounded(spark, moves, 50.0, 0.3, 40), moves, strict=True):
        assert r["capital"] == pytest.approx(capital, rel=1e-9, abs=1e-9)
        capital = max(0.0, capital * (1 + 0.01 * m) - 0.3) if capital > 0 else 0.0
