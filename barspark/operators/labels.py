"""Barrier labels and trade outcomes that look at later bars."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.functions.study import Study
from barspark.functions.sizing import levels as level_columns
from barspark.plans.chunks import CHUNK, CORE, chunked_rows
from barspark.plans.ladder import first_touch, forward_bars, target_first

# Columns tried for the ATR of a label, and the percent levels used without ATR.
ATR_COLUMNS = ("atr_m5", "ATR_M5")
NO_ATR_STOP, NO_ATR_TARGET = 0.999, 1.002


def check_label_params(sl: float, tp: float, min_hold: int, horizon: int) -> None:
    if sl <= 0 or tp <= 0:
        raise ValueError("ATR multipliers must be positive")
    if min_hold < 1:
        raise ValueError(f"min_hold must be >= 1, got {min_hold}")
    if horizon < min_hold:
        raise ValueError(f"horizon ({horizon}) must be >= min_hold ({min_hold})")


def require_labels(labelled: DataFrame) -> DataFrame:
    """The frame itself, or an error when the horizon left no label (checks one row)."""
    if not labelled.limit(1).count():
        raise ValueError("no labels: not enough rows for the horizon")
    return labelled


def first_barrier(close, high, low, atr, sl: float, tp: float, min_hold: int, horizon: int, slippage: float = 0.0) -> np.ndarray:
    """1 where the target is touched strictly before the stop, for the rows of one series with a full horizon ahead.

    All rows look one bar further at a time, and those that have touched a level drop out.
    """
    stop, target = close - atr * sl + slippage, close + atr * tp - slippage
    won = np.zeros(max(len(close) - horizon, 0), np.int32)
    going = np.arange(len(won))
    for k in range(min_hold, horizon + 1):
        if not len(going):
            break
        up, down = high[going + k] >= target[going], low[going + k] <= stop[going]
        won[going[up & ~down]] = 1
        going = going[~(up | down)]
    return won


def _by_chunk(bars: DataFrame, horizon: int, keys: Sequence[str], ts: str, chunk_rows: int | None) -> tuple[DataFrame, Callable]:
    """Rows with ATR in chunks that hold the horizon of each row, and what reads a chunk's arrays."""
    s = Study()
    given = next((c for c in ATR_COLUMNS if c in bars.columns), None)
    atr = given or s.atr(14)
    s.put("_atr", [atr], lambda line: F.col(atr).cast("double"), keep=True)
    cut = chunked_rows(bars, keys=keys, ts=ts, back=s.back, ahead=horizon, chunk_rows=chunk_rows)

    def arrays(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
        pdf = pdf.sort_values(ts, kind="stable", na_position="first")
        return pdf, [pdf[c].to_numpy(np.float64, na_value=np.nan) for c in ("close", "high", "low", "_atr")]

    return s.on(cut.df, cut.line), arrays


def barrier_label(
    bars: DataFrame,
    sl: float = 2.0,
    tp: float = 4.0,
    min_hold: int = 10,
    horizon: int = 120,
    slippage: float = 0.0,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add ``label``: 1 when the target is touched strictly before the stop within the horizon.

    A tie or a timeout is 0; rows without a full horizon ahead are dropped. Which level is touched first depends on
    each row's own levels, so no window function tells it; a chunk is searched with arrays, none of them per row.
    """
    check_label_params(sl, tp, min_hold, horizon)
    rows, arrays = _by_chunk(bars, horizon, keys, ts, chunk_rows)
    out = T.StructType([*bars.schema.fields, T.StructField("label", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, prices = arrays(pdf)
        won = first_barrier(*prices, sl, tp, min_hold, horizon, slippage)
        ready = pdf.iloc[: len(won)].assign(label=won)
        return ready.loc[ready[CORE], out.fieldNames()]

    return rows.groupBy(*keys, CHUNK).applyInPandas(run, out)


def label_sweep(
    bars: DataFrame,
    pairs: Sequence[tuple[float, float]],
    min_hold: int = 10,
    horizon: int = 120,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Positive share per (sl, tp) pair; a chunk is read once for all pairs."""
    for sl, tp in pairs:
        check_label_params(sl, tp, min_hold, horizon)
    rows, arrays = _by_chunk(bars.select(*keys, ts, "high", "low", "close", *[c for c in ATR_COLUMNS if c in bars.columns]), horizon, keys, ts, chunk_rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, prices = arrays(pdf)
        lines = []
        for sl, tp in pairs:
            won = first_barrier(*prices, sl, tp, min_hold, horizon)
            own = won[pdf[CORE].to_numpy(bool)[: len(won)]]
            lines.append((float(sl), float(tp), len(own), int(own.sum())))
        return pd.DataFrame(lines, columns=["sl", "tp", "n", "positive"])

    counts = rows.groupBy(*keys, CHUNK).applyInPandas(run, "sl double, tp double, n long, positive long")
    sums = counts.groupBy("sl", "tp").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).where("n > 0")
    return sums.withColumn("positive_pct", 100.0 * F.col("positive") / F.col("n"))


def levels(rows: DataFrame, sl: float = 1.0, tp: float = 2.0, *, price: str = "close", atr: str = "atr") -> DataFrame:
    """Add sl_price, tp_price and rr from multiples of ATR."""
    stop, target, rr = level_columns(F.col(price), F.col(atr), sl, tp)
    return rows.withColumns({"sl_price": stop, "tp_price": target, "rr": rr})


def first_exit(
    entries: DataFrame,
    bars: DataFrame,
    *,
    sl: float = 1.0,
    tp: float = 1.8,
    tie: str = "near_open",
    price: str = "close",
    atr: str = "atr",
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    keep_open: bool = False,
) -> DataFrame:
    """Exit of every entry at the first later bar that reaches a level, however far away.

    Entries without ATR use fixed percent levels; entries that never exit are dropped unless
    ``keep_open``. Existing sl_price/tp_price columns are used as they are.
    """
    if "sl_price" not in entries.columns:
        p, a = F.col(price), F.col(atr) if atr in entries.columns else F.lit(None).cast("double")
        known = a.isNotNull() & ~F.isnan(a)
        entries = entries.withColumns(
            {
                "sl_price": F.when(known, p - sl * a).otherwise(p * NO_ATR_STOP),
                "tp_price": F.when(known, p + tp * a).otherwise(p * NO_ATR_TARGET),
            }
        )
    hit = first_touch(entries, bars, keys=keys, ts=ts, out="_touch")
    if not keep_open:
        hit = hit.where(F.col("_touch").isNotNull())
    win = target_first(F.col("_touch"), F.col("sl_price"), F.col("tp_price"), tie)
    return hit.withColumns(
        {
            "exit_ts": F.col("_touch.ts"),
            "is_win": win,
            "exit_price": F.when(win, F.col("tp_price")).when(~win, F.col("sl_price")),
        }
    ).drop("_touch")


def scan_outcome(
    signals: DataFrame,
    bars: DataFrame,
    *,
    sl: float = 1.0,
    tp: float = 2.0,
    min_hold: int = 10,
    horizon: int = 300,
    atr: str = "atr",
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Outcome of entering at the next bar's open with levels re-based on that price.

    Bars from min_hold to horizon-1 after the entry bar are checked, target first; then Timeout at the
    last close. Unusable ATR gives InvalidATR, no next bar gives Pending.
    """
    look = forward_bars(signals, bars, horizon, keys=keys, ts=ts, out="_fwd", chunk_rows=chunk_rows)
    entry = F.get("_fwd", F.lit(0))
    a = F.col(atr)
    staged = look.withColumns({"entry_ts": entry[ts], "entry_price": entry["open"]}).withColumns(
        {"sl_price": F.col("entry_price") - a * sl, "tp_price": F.col("entry_price") + a * tp}
    )
    # `_fwd` is 0-based from the entry bar and holds exactly the bars up to the limit.
    tail = F.filter(
        F.col("_fwd"),
        lambda b, i: (i >= min_hold) & ((b["high"] >= F.col("tp_price")) | (b["low"] <= F.col("sl_price"))),
    )
    staged = staged.withColumns({"_hit": F.get(tail, F.lit(0)), "_end": F.get("_fwd", F.size("_fwd") - 1)})
    invalid = F.coalesce(a <= 0, F.lit(True)) | F.coalesce(F.isnan(a), F.lit(False))
    win = F.col("_hit.high") >= F.col("tp_price")
    outcome = (
        F.when(F.col("entry_price").isNull(), "Pending")
        .when(invalid, "InvalidATR")
        .when(F.col("_hit").isNull(), "Timeout")
        .when(win, "Win")
        .otherwise("Loss")
    )
    out = staged.withColumn("outcome", outcome)
    done = F.col("outcome").isin("Win", "Loss", "Timeout")
    exit_price = (
        F.when(F.col("outcome") == "Win", F.col("tp_price"))
        .when(F.col("outcome") == "Loss", F.col("sl_price"))
        .when(F.col("outcome") == "Timeout", F.col("_end.close"))
    )
    return (
        out.withColumn("exit_ts", F.when(done, F.coalesce(F.col(f"_hit.{ts}"), F.col(f"_end.{ts}"))))
        .withColumn("exit_price", exit_price)
        .withColumn("profit_loss", F.col("exit_price") - F.col("entry_price"))
        .drop("_fwd", "_hit", "_end", "n_bars")
    )


def mark_open(
    trades: DataFrame,
    bars: DataFrame,
    asof: str,
    *,
    min_hold: int = 10,
    horizon: int = 300,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """State of trades at time ``asof``: Win, Loss, Timeout or Pending with the unrealised result.

    ``trades`` carry the entry bar's time in ``ts``, entry_price, sl_price and tp_price.
    """
    at = F.lit(asof).cast("timestamp_ntz")
    # The horizon ends `horizon` bars after the entry bar or at the last bar there is, whichever is first.
    look = forward_bars(trades, bars, horizon, keys=keys, ts=ts, out="_fwd", chunk_rows=chunk_rows)
    seen = F.filter(F.col("_fwd"), lambda b: b[ts] <= at)
    staged = look.withColumns({"_seen": seen, "_full": F.size("_fwd"), "_left": F.size(seen)})
    hit = F.filter(
        F.col("_seen"),
        lambda b, i: (i + 1 >= min_hold) & ((b["high"] >= F.col("tp_price")) | (b["low"] <= F.col("sl_price"))),
    )
    staged = staged.withColumns({"_hit": F.get(hit, F.lit(0)), "_end": F.get("_seen", F.size("_seen") - 1)})
    outcome = (
        F.when(F.col("_hit").isNull(), F.when(F.col("_left") == F.col("_full"), "Timeout").otherwise("Pending"))
        .when(F.col("_hit.high") >= F.col("tp_price"), "Win")
        .otherwise("Loss")
    )
    staged = staged.withColumn("outcome", outcome)
    price = (
        F.when(F.col("outcome") == "Win", F.col("tp_price"))
        .when(F.col("outcome") == "Loss", F.col("sl_price"))
        .otherwise(F.col("_end.close"))
    )
    return staged.withColumns(
        {
            "exit_ts": F.coalesce(F.col(f"_hit.{ts}"), F.col(f"_end.{ts}")),
            "exit_price": price,
            "profit_loss": price - F.col("entry_price"),
        }
    ).drop("_fwd", "_seen", "_full", "_left", "_hit", "_end", "n_bars")


def verify_exits(
    trades: DataFrame, bars: DataFrame, *, tie: str = "loss", keys: Sequence[str] = ("symbol",), ts: str = "ts"
) -> DataFrame:
    """Recompute exits of listed trades and compare with expected_exit_ts / expected_win."""
    redone = first_exit(trades, bars, tie=tie, keys=keys, ts=ts, keep_open=True)
    same = F.col("exit_ts").eqNullSafe(F.col("expected_exit_ts")) & F.col("is_win").eqNullSafe(F.col("expected_win"))
    return redone.withColumn("matches", same)
