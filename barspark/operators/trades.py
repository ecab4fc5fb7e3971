"""From signals to trades, equity and stress scenarios."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.functions.calendar import in_session
from barspark.functions.sizing import transaction_cost
from barspark.functions.study import Study
from barspark.operators.labels import first_exit
from barspark.operators.splits import walk_forward_days
from barspark.plans.chunks import join_on, with_row_index
from barspark.plans.scan import running
from barspark.plans.series import IDX, STRETCH, cut_series
from barspark.plans.steps import PIECE, STATE, entry_states, pieces_of
from barspark.session import cut_lineage


@dataclass(frozen=True)
class Scenario:
    name: str
    spread: float
    commission: float
    threshold: float


def stress_scenarios(threshold: float) -> list[Scenario]:
    """Nominal costs, ten times the spread with four times the commission, stricter threshold."""
    return [
        Scenario("nominal", 0.0001, 0.0005, threshold),
        Scenario("wide_spreads", 0.001, 0.002, threshold),
        Scenario("conservative", 0.0001, 0.0005, threshold + 0.10),
    ]


def candidate_signals(predictions: DataFrame, min_probability: float = 0.5) -> DataFrame:
    return predictions.where((F.col("prediction") == 1) & (F.col("probability") >= min_probability))


# -- one position at a time ------------------------------------------------------------------------


def _walk(starts: np.ndarray, ends: np.ndarray, days: np.ndarray, cap: int, free_at: int, day: int, used: int) -> np.ndarray:
    """Positions taken when one may be opened from ``free_at``, and ``used`` were on ``day``."""
    n = len(starts)
    next_day = np.searchsorted(days, days, side="right")
    taken = []
    i = int(np.searchsorted(starts, free_at, side="left"))
    while i < n:
        if day != days[i]:
            day, used = days[i], 0
        if cap and used >= cap:
            i = int(next_day[i])
            continue
        taken.append(i)
        used += 1
        i = max(i + 1, int(np.searchsorted(starts, ends[i], side="left")))
    return np.asarray(taken, dtype=np.int64)


def _micros(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def non_overlapping(
    trades: DataFrame,
    *,
    max_per_day: int | None = None,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    exit_ts: str = "exit_ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Trades actually taken when only one may be open: a signal before the open trade's exit is skipped.

    The exit bar may re-enter; a signal without entry or exit time is no trade. ``max_per_day`` counts taken trades by entry date.

    The choice depends on the past only through a small state, so stretches of the series are solved and combined
    as step functions (``plans/steps.py``), and then all are walked in parallel from the state they begin with.
    """
    keys = tuple(keys)
    cap = int(max_per_day or 0)
    base = trades.where(F.col(ts).isNotNull() & F.col(exit_ts).isNotNull()).withColumns(
        {"_s": _micros(ts), "_e": _micros(exit_ts), "_d": F.unix_date(F.to_date(ts)).cast("long")}
    )
    names = trades.columns
    placed = cut_series(base, keys=keys, order=("_s", "_e"), part_rows=chunk_rows).df.withColumnRenamed(STRETCH, "at")
    key_fields = [base.schema[k] for k in keys]
    piece = T.StructType([*key_fields, T.StructField("at", T.LongType()), *[T.StructField(c, T.LongType()) for c in PIECE]])

    def arrays(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
        pdf = pdf.sort_values(IDX, kind="stable")
        return pdf, [pdf[c].to_numpy(np.int64) for c in ("_s", "_e", "_d")]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, (starts, ends, days) = arrays(pdf)
        out = pd.DataFrame(pieces_of(starts, ends, days, cap), columns=list(PIECE))
        for k in (*keys, "at"):
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "at", *PIECE]]

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, (starts, ends, days) = arrays(pdf)
        state = [int(pdf[f"_from_{c}"].iloc[0]) for c in STATE]
        return pdf.iloc[_walk(starts, ends, days, cap, *state)][names]

    solved = placed.select(*keys, "at", IDX, "_s", "_e", "_d").groupBy(*keys, "at").applyInPandas(solve, piece)
    before = entry_states(cut_lineage(solved), key_fields)
    before = before.select(*keys, "at", *[F.col(c).alias(f"_from_{c}") for c in STATE])
    return join_on(placed, before, [*keys, "at"]).groupBy(*keys, "at").applyInPandas(take, base.select(*names).schema)


def first_k_per_day(
    signals: DataFrame, k: int, *, keys: Sequence[str] = ("symbol",), ts: str = "ts"
) -> DataFrame:
    """The first k signals of each day, for trades that do not depend on each other."""
    w = Window.partitionBy(*keys, F.to_date(ts)).orderBy(ts)
    return signals.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def trade_pnl(
    trades: DataFrame,
    *,
    size: Column | float = 0.01,
    cost: float | None = None,
    entry: str = "entry_price",
    ts: str = "ts",
    exit_ts: str = "exit_ts",
) -> DataFrame:
    """Add position_size, gross_pnl, transaction_cost, pnl and duration_minutes."""
    cost = transaction_cost() if cost is None else cost
    lots = F.lit(float(size)) if isinstance(size, (int, float)) else size
    gross = F.col("position_size") * (F.col("exit_price") - F.col(entry))
    return trades.withColumn("position_size", lots).withColumns(
        {
            "gross_pnl": gross,
            "transaction_cost": F.lit(float(cost)),
            "pnl": gross - cost,
            "duration_minutes": (_micros(exit_ts) - _micros(ts)) / 60_000_000.0,
        }
    )


def take_trades(
    predictions: DataFrame,
    bars: DataFrame,
    *,
    sl: float = 1.0,
    tp: float = 1.8,
    min_probability: float = 0.5,
    max_per_day: int | None = None,
    size: Column | float = 0.01,
    cost: float | None = None,
    tie: str = "near_open",
    keys: Sequence[str] = ("symbol",),
    group: Sequence[str] = (),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Candidates, their exits (all in parallel), the non-overlapping choice, then P&L.

    ``group`` adds columns such as a window or strategy id to the one-position rule.
    """
    signals = candidate_signals(predictions, min_probability)
    if "entry_price" not in signals.columns:
        signals = signals.join(bars.select(*keys, ts, F.col("close").alias("entry_price")), [*keys, ts])
    exits = first_exit(signals, bars, sl=sl, tp=tp, tie=tie, price="entry_price", keys=keys, ts=ts)
    taken = non_overlapping(exits, max_per_day=max_per_day, keys=(*keys, *group), ts=ts, chunk_rows=chunk_rows)
    return trade_pnl(taken, size=size, cost=cost, ts=ts)


# -- equity ----------------------------------------------------------------------------------------


def equity_curve(
    predictions: DataFrame,
    trades: DataFrame,
    initial: float = 100_000.0,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """(keys, seq, ts, equity): the start, then one point per prediction that no open trade skips."""
    keys = tuple(keys)
    points = predictions.select(*keys, ts).join(
        trades.select(*keys, ts, F.col("exit_ts").alias("_x"), F.col("pnl").alias("_p")), [*keys, ts], "left"
    )
    line = cut_series(points, keys=keys, order=(ts,), part_rows=chunk_rows)
    run = line.running({"_open": ("max", "_x"), "_won": ("sum", "_p")})
    kept = F.col("_x").isNotNull() | F.col("_open").isNull() | (F.col(ts) >= F.col("_open"))
    numbered = run.having(run.df.withColumn("_kept", F.coalesce(kept, F.lit(False)).cast("long"))).running({"seq": ("sum", "_kept")})
    equity = F.lit(float(initial)) + F.coalesce("_won", F.lit(0.0))
    body = numbered.df.where("_kept = 1").select(*keys, "seq", ts, equity.alias("equity"))
    return _started(line.df, body, initial, keys, ts)


def _started(rows: DataFrame, body: DataFrame, initial: float, keys: Sequence[str], ts: str) -> DataFrame:
    """The curve with its first point: the initial capital at the earliest time."""
    start = rows.groupBy(*keys).agg(F.min(ts).alias(ts))
    return start.select(*keys, F.lit(0).cast("long").alias("seq"), ts, F.lit(float(initial)).alias("equity")).unionByName(body)


def trade_equity(
    trades: DataFrame, initial: float = 100_000.0, *, keys: Sequence[str] = ("symbol",), ts: str = "ts", chunk_rows: int | None = None
) -> DataFrame:
    """(keys, seq, ts, equity): initial plus the running P&L, one point per trade."""
    line = cut_series(trades.select(*keys, ts, "pnl"), keys=keys, order=(ts,), part_rows=chunk_rows)
    equity = F.lit(float(initial)) + F.col("_won")
    body = line.running({"_won": ("sum", "pnl")}).df.select(*keys, (F.col(IDX) + 1).alias("seq"), ts, equity.alias("equity"))
    return _started(line.df, body, initial, keys, ts)


def _breach(equity: DataFrame, limit: float, keys: Sequence[str], ts: str, chunk_rows: int | None) -> DataFrame:
    """(keys, _stop, _at): number and time of the first point whose fall from the peak reaches the limit."""
    run = running(equity, {"_peak": ("max", "equity")}, keys=keys, ts=ts, order=("seq",))
    fallen = F.try_divide(F.col("_peak") - F.col("equity"), F.col("_peak")) >= limit
    first = run.where(fallen).groupBy(*keys).agg(F.min(F.struct("seq", ts)).alias("_b"))
    return first.select(*keys, F.col("_b.seq").alias("_stop"), F.col(f"_b.{ts}").alias("_at"))


def drawdown_stop(
    equity: DataFrame, limit: float = 0.20, *, keys: Sequence[str] = ("symbol",), ts: str = "ts", chunk_rows: int | None = None
) -> DataFrame:
    """Points up to and including the first one whose fall from the peak reaches the limit."""
    breach = _breach(equity, limit, keys, ts, chunk_rows)
    return join_on(equity, breach, keys, "left").where(F.col("_stop").isNull() | (F.col("seq") <= F.col("_stop"))).drop("_stop", "_at")


def stop_trading(
    trades: DataFrame, equity: DataFrame, limit: float = 0.20, *, keys: Sequence[str] = ("symbol",), ts: str = "ts", chunk_rows: int | None = None
) -> DataFrame:
    """Trades entered up to the point where ``drawdown_stop`` ends the curve: none is made after it."""
    breach = _breach(equity, limit, keys, ts, chunk_rows)
    return join_on(trades, breach, keys, "left").where(F.col("_at").isNull() | (F.col(ts) <= F.col("_at"))).drop("_stop", "_at")


def compound_trades(
    trades: DataFrame,
    per_capital: Column,
    initial: float = 100_000.0,
    *,
    cost: float | None = None,
    entry: str = "entry_price",
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Sizes that follow the capital: add capital (before the trade), position_size, gross_pnl, transaction_cost and pnl.

    ``per_capital`` is the lots per unit of capital, as risk and Kelly sizing give before their bounds. A trade maps
    the capital c > 0 to max(0, c * g - cost), and 0 to 0: who has nothing left trades no more. Such maps combine
    to max(0, c * a - b), so every stretch of trades is one pair (a, b), kept as fractions with a common power of two; the
    pairs of a series, one per stretch, are chained, and then all stretches are walked in parallel.

    A trade without prices or size leaves the capital as it is, with null size and result. Capital and what follows
    from it are null where they pass the range of a double.
    """
    cost = float(transaction_cost() if cost is None else cost)
    if cost < 0:
        raise ValueError("cost must not be negative")
    keys = tuple(keys)
    names = trades.columns
    grown = trades.withColumn("_u", per_capital.cast("double"))
    grown = grown.withColumn("_g", 1 + F.col("_u") * (F.col("exit_price") - F.col(entry)))
    line = cut_series(grown, keys=keys, order=(ts,), part_rows=chunk_rows).df
    key_fields = [grown.schema[k] for k in keys]
    pair = T.StructType([*key_fields, T.StructField(STRETCH, T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("_a", "_b")], T.StructField("_p", T.LongType())])
    state = T.StructType([*key_fields, T.StructField(STRETCH, T.LongType()), T.StructField("_m", T.DoubleType()), T.StructField("_p", T.LongType())])

    def named(pdf: pd.DataFrame, data: dict, order: Sequence[str]) -> pd.DataFrame:
        out = pd.DataFrame(data)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, *order]]

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, p = 1.0, 0.0, 0
        for g in pdf.sort_values(IDX)["_g"].dropna().tolist():
            a, b, p = _scaled(a * max(g, 0.0), b * max(g, 0.0) + _shifted(cost, -p), p)
        return named(pdf, {STRETCH: [int(pdf[STRETCH].iloc[0])], "_a": [a], "_b": [b], "_p": [p]}, [STRETCH, "_a", "_b", "_p"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        lines, (m, _, p) = [], _scaled(float(initial), 0.0, 0)
        pdf = pdf.sort_values(STRETCH)
        for at, a, b, q in zip(*(pdf[c].tolist() for c in (STRETCH, "_a", "_b", "_p")), strict=True):
            lines.append((at, m, p))
            # The pair is at 2 ** q, and the capital m at 2 ** p.
            m, _, p = _scaled(max(0.0, m * a - _shifted(b, -p)), 0.0, p + q)
        at, m, p = zip(*lines, strict=True)
        return named(pdf, {STRETCH: at, "_m": m, "_p": p}, [STRETCH, "_m", "_p"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX, kind="stable")
        m, p, held = float(pdf["_m"].iloc[0]), int(pdf["_p"].iloc[0]), []
        for g in pdf["_g"].tolist():
            held.append(_shifted(m, p))
            if g == g:
                m, _, p = _scaled(max(0.0, m * max(g, 0.0) - _shifted(cost, -p)), 0.0, p)
        return pdf.assign(capital=held)[[*names, "_u", "_g", "capital"]]

    solved = line.select(*keys, STRETCH, IDX, "_g").groupBy(*keys, STRETCH).applyInPandas(pairs, pair)
    before = solved.groupBy(*keys).applyInPandas(chain, state)
    walked = T.StructType([*(f for f in grown.schema.fields if f.name != "capital"), T.StructField("capital", T.DoubleType())])
    out = join_on(line, before, [*keys, STRETCH]).groupBy(*keys, STRETCH).applyInPandas(walk, walked)
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    out = out.withColumn("capital", finite(F.col("capital")))
    out = out.withColumn("position_size", finite(F.col("_u") * F.col("capital")))
    out = out.withColumn("gross_pnl", finite(F.col("position_size") * (F.col("exit_price") - F.col(entry))))
    paid = F.when(F.col("_g").isNotNull(), F.when(F.col("capital") > 0, F.lit(cost)).otherwise(F.lit(0.0)))
    # No more is lost than there is.
    out = out.withColumn("transaction_cost", paid).withColumn(
        "pnl", F.when(F.col("gross_pnl").isNotNull(), F.greatest(F.col("gross_pnl") - F.col("transaction_cost"), -F.col("capital")))
    )
    return out.drop("_u", "_g")


def _shifted(x: float, power: int) -> float:
    """x * 2 ** power, infinite beyond the range of a double."""
    try:
        return math.ldexp(x, power)
    except OverflowError:
        return math.inf


def _scaled(a: float, b: float, power: int) -> tuple[float, float, int]:
    """The pair with a power of two moved out of it, so that the larger of the two is between 1/2 and 1."""
    shift = math.frexp(max(a, b))[1]
    return math.ldexp(a, -shift), math.ldexp(b, -shift), power + shift


def compound_equity(
    returns: DataFrame,
    initial: float = 10_000.0,
    *,
    r: str = "ret",
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add ``equity`` = initial times the product of (1 + return); a null return carries forward."""
    logs = returns.withColumn("_lg", F.log1p(F.coalesce(F.col(r), F.lit(0.0))))
    run = running(logs, {"_sum": ("sum", "_lg")}, keys=keys, ts=ts)
    return run.withColumn("equity", F.lit(float(initial)) * F.exp("_sum")).drop("_lg", "_sum")


def stress(
    bars: DataFrame,
    scenarios: Sequence[Scenario],
    *,
    p: str = "probability",
    initial: float = 10_000.0,
    max_per_day: int | None = None,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Next-bar trades under every scenario: (scenario, keys, ts, ret, equity).

    Scenarios are a short literal array exploded per row, so the rows are read and ordered once.
    """

    s = Study()
    s.out("_after", s.put("_nx", ["close"], lambda line: line.next("close"), ahead=1))
    base = s.apply(bars, keys=keys, ts=ts, chunk_rows=chunk_rows)
    lits = F.array(
        *[
            F.struct(
                F.lit(x.name).alias("scenario"),
                F.lit(x.spread).alias("spread"),
                F.lit(x.commission).alias("commission"),
                F.lit(x.threshold).alias("threshold"),
            )
            for x in scenarios
        ]
    )
    each = base.withColumn("_s", F.explode(lits)).select("*", "_s.*").drop("_s")
    signal = (F.col(p) >= F.col("threshold")) & F.col("_after").isNotNull()
    if max_per_day:
        fired = first_k_per_day(
            each.where(F.col(p) >= F.col("threshold")).select("scenario", *keys, ts), max_per_day, keys=("scenario", *keys), ts=ts
        ).withColumn("_on", F.lit(True))
        each = each.join(fired, ["scenario", *keys, ts], "left")
        signal = signal & F.coalesce(F.col("_on"), F.lit(False))
    sell = (1 - F.col("spread") / 2) * (1 - F.col("commission"))
    buy = (1 + F.col("spread") / 2) * (1 + F.col("commission"))
    ret = F.when(signal, F.try_divide(F.col("_after") * sell, F.col("close") * buy) - 1)
    slim = each.select("scenario", *keys, ts, ret.alias("ret"))
    return compound_equity(slim, initial, keys=("scenario", *keys), ts=ts)


def walk_forward_trades(
    predictions: DataFrame,
    bars: DataFrame,
    *,
    train_days: int = 180,
    test_days: int = 30,
    step_days: int = 30,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    **rules,
) -> DataFrame:
    """Trades of every calendar test window; each window starts flat."""
    windows = walk_forward_days(predictions, train_days, test_days, step_days, keys=keys, ts=ts)
    return take_trades(windows, bars, keys=keys, ts=ts, group=("window_id",), **rules)


def scan_signals(
    scored: DataFrame,
    *,
    threshold: str | float = "threshold",
    step: int = 60,
    window: int = 80,
    fine_per_bar: int = 5,
    min_candles: int = 0,
    session: str = "london_ny",
    overlap: bool = True,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Rows looked at when a series is scanned every ``step`` bars inside a session, and that signal.

    The first look needs max(min_candles, window + 200) coarse bars of context. ``overlap=False``
    additionally applies the one-position rule (the rows then need ``exit_ts``).
    """
    context = max(min_candles, window + 200) * fine_per_bar
    placed = with_row_index(scored, keys=keys, ts=ts, index="_i", total="_n")
    looked = placed.where(
        (F.col("_i") >= context - 1) & ((F.col("_i") - (context - 1)) % step == 0) & in_session(ts, session)
    ).drop("_i", "_n")
    bound = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    hits = looked.where((F.col("prediction") == 1) & (F.col("probability") >= bound))
    return hits if overlap else non_overlapping(hits, keys=keys, ts=ts, chunk_rows=chunk_rows)
