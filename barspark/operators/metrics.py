"""Return, risk and trade metrics per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.study import Study
from barspark.plans.scan import exact_quantiles, running
from barspark.plans.series import Series, cut_series

# Standard deviations below this count as no risk.
NO_RISK = 1e-10
Keys = Sequence[str]


def returns(
    equity: DataFrame, *, keys: Keys = ("symbol",), ts: str = "ts", order: Keys = ("seq",), chunk_rows: int | None = None
) -> DataFrame:
    """Add ``ret``: change of equity to the point before, 0 at the first point."""
    return _change().apply(equity, keys=keys, ts=ts, order=order, chunk_rows=chunk_rows)


def _change() -> Study:
    s = Study()
    change = s.roc("equity", 1)
    s.calc("ret", [change], lambda: F.coalesce(F.col(change), F.lit(0.0)), keep=True)
    return s


def check_equity(equity: DataFrame) -> DataFrame:
    """The frame itself, or an error when equity has a point that is not finite and positive."""
    e = F.col("equity")
    bad = equity.where(e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")) | (e <= 0)).limit(1).count()
    if bad:
        raise ValueError("equity must be finite and positive")
    return equity


def _total(initial: float) -> Column:
    return (F.max_by("equity", "seq") - initial) / initial


def total_return(equity: DataFrame, initial: float, *, keys: Keys = ("symbol",)) -> DataFrame:
    if initial <= 0:
        raise ValueError("initial capital must be positive")
    return equity.groupBy(*keys).agg(_total(initial).alias("total_return"))


def _annual(total: Column, n: Column, ppy: float) -> Column:
    return F.when(n >= 2, F.pow(1 + total, F.lit(float(ppy)) / n) - 1)


def annualized_return(equity: DataFrame, initial: float, ppy: float = 252, *, keys: Keys = ("symbol",)) -> DataFrame:
    facts = equity.groupBy(*keys).agg(_total(initial).alias("_t"), F.count(F.lit(1)).alias("_n"))
    return facts.select(*keys, _annual(F.col("_t"), F.col("_n"), ppy).alias("annualized_return"))


def _sharpe(ret: str, rf: float, ppy: float) -> Column:
    std = F.stddev_samp(ret)
    return F.when(std >= NO_RISK, (F.avg(ret) - rf / ppy) / std * ppy**0.5)


def sharpe_ratio(rets: DataFrame, rf: float = 0.0, ppy: float = 252, *, ret: str = "ret", keys: Keys = ("symbol",)) -> DataFrame:
    return rets.groupBy(*keys).agg(_sharpe(ret, rf, ppy).alias("sharpe_ratio"))


def _sortino(ret: str, rf: float, ppy: float) -> Column:
    std = F.stddev_samp(F.when(F.col(ret) < 0, F.col(ret)))
    return F.when(std > 0, (F.avg(ret) - rf / ppy) / std * ppy**0.5)


def sortino_ratio(rets: DataFrame, rf: float = 0.0, ppy: float = 252, *, ret: str = "ret", keys: Keys = ("symbol",)) -> DataFrame:
    return rets.groupBy(*keys).agg(_sortino(ret, rf, ppy).alias("sortino_ratio"))


def drawdowns(equity: DataFrame, *, keys: Keys = ("symbol",), ts: str = "ts", chunk_rows: int | None = None) -> DataFrame:
    """Add ``peak`` (highest equity so far) and ``drawdown`` = (peak - equity) / peak."""
    run = running(equity, {"peak": ("max", "equity")}, keys=keys, ts=ts, order=("seq",))
    return run.withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))


def _topped(line: Series, ts: str) -> Series:
    """Add ``_top``: the highest equity up to the row, with the first number and time it was reached at."""
    point = F.struct("equity", (-F.col("seq")).alias("s"), F.col(ts).alias("at"))
    return line.having(line.df.withColumn("_point", point)).running({"_top": ("max", "_point")})


def _worst(ts: str) -> Column:
    """The largest fall from a peak with both places; of equal ones the first."""
    fall = (F.col("_top.equity") - F.col("equity")) / F.col("_top.equity")
    return F.max(F.struct(fall.alias("fall"), (-F.col("seq")).alias("s"), F.col(ts).alias("at"), F.col("_top.at").alias("peak_at")))


def _drawdown_columns(worst: str) -> list[Column]:
    lost = F.col(f"{worst}.fall") > 0
    return [
        F.col(f"{worst}.fall").alias("max_drawdown"),
        F.when(lost, F.col(f"{worst}.peak_at")).alias("peak_ts"),
        F.when(lost, F.col(f"{worst}.at")).alias("trough_ts"),
    ]


def max_drawdown(equity: DataFrame, *, keys: Keys = ("symbol",), ts: str = "ts", chunk_rows: int | None = None) -> DataFrame:
    """Largest drawdown with its peak and trough times; the first of equal ones; nulls when there is none."""
    line = cut_series(equity.select(*keys, ts, "seq", "equity"), keys=keys, order=("seq",), part_rows=chunk_rows)
    return _topped(line, ts).df.groupBy(*keys).agg(_worst(ts).alias("_w")).select(*keys, *_drawdown_columns("_w"))


def calmar_ratio(
    rets: DataFrame, equity: DataFrame, ppy: float = 252, *, ret: str = "ret", keys: Keys = ("symbol",), ts: str = "ts"
) -> DataFrame:
    mean = rets.groupBy(*keys).agg((F.avg(ret) * ppy).alias("_a"))
    dd = max_drawdown(equity, keys=keys, ts=ts)
    return mean.join(dd, list(keys)).select(
        *keys, F.when(F.col("max_drawdown") > 0, F.col("_a") / F.col("max_drawdown")).alias("calmar_ratio")
    )


def value_at_risk(rets: DataFrame, confidence: float = 0.95, *, ret: str = "ret", keys: Keys = ("symbol",)) -> DataFrame:
    """max(0, -quantile(1 - confidence)) of historical returns."""
    if not 0 < confidence < 1:
        raise ValueError(f"confidence must be in (0, 1), got {confidence}")
    q = exact_quantiles(rets, ret, [1 - confidence], keys=keys)
    return q.select(*keys, F.greatest(F.lit(0.0), -F.col("q")).alias("var"))


def conditional_var(rets: DataFrame, confidence: float = 0.95, *, ret: str = "ret", keys: Keys = ("symbol",)) -> DataFrame:
    """Mean loss at or beyond VaR; VaR itself where no return is that low."""
    var = value_at_risk(rets, confidence, ret=ret, keys=keys)
    tail = rets.join(var, list(keys)).where(F.col(ret) <= -F.col("var")).groupBy(*keys).agg((-F.avg(ret)).alias("_c"))
    return var.join(tail, list(keys), "left").select(*keys, "var", F.coalesce("_c", "var").alias("cvar"))


def _win_rate() -> Column:
    return F.coalesce(F.avg((F.col("pnl") > 0).cast("double")), F.lit(0.0))


def win_rate(trades: DataFrame, *, keys: Keys = ("symbol",)) -> DataFrame:
    return trades.groupBy(*keys).agg(_win_rate().alias("win_rate"))


def _won() -> Column:
    return F.coalesce(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0))


def _lost() -> Column:
    return F.abs(F.coalesce(F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))), F.lit(0.0)))


def _profit_factor() -> Column:
    return F.when(_lost() > 0, _won() / _lost()).when(_won() > 0, F.lit(None).cast("double")).otherwise(0.0)


def profit_factor(trades: DataFrame, *, keys: Keys = ("symbol",)) -> DataFrame:
    """Won over lost money; null with ``no_losses`` set where nothing was lost."""
    return trades.groupBy(*keys).agg(
        _profit_factor().alias("profit_factor"), ((_lost() == 0) & (_won() > 0)).alias("no_losses")
    )


def _avg_win_loss() -> Column:
    won = F.avg(F.when(F.col("pnl") > 0, F.col("pnl")))
    lost = F.abs(F.avg(F.when(F.col("pnl") < 0, F.col("pnl"))))
    return F.coalesce(F.try_divide(won, lost), F.lit(0.0))


def avg_win_loss(trades: DataFrame, *, keys: Keys = ("symbol",)) -> DataFrame:
    return trades.groupBy(*keys).agg(_avg_win_loss().alias("avg_win_loss_ratio"))


def all_metrics(
    equity: DataFrame,
    trades: DataFrame,
    initial: float,
    ppy: float = 252,
    rf: float = 0.0,
    *,
    keys: Keys = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """One row per group with every return, risk and trade metric."""
    line = cut_series(equity.select(*keys, ts, "seq", "equity"), keys=keys, order=("seq",), part_rows=chunk_rows)
    line = _topped(_change().on_series(line), ts)
    rets = line.df.select(*keys, "ret")
    curve = line.df.groupBy(*keys).agg(
        _total(initial).alias("total_return"),
        F.count(F.lit(1)).alias("_n"),
        _sharpe("ret", rf, ppy).alias("sharpe_ratio"),
        _sortino("ret", rf, ppy).alias("sortino_ratio"),
        (F.stddev_samp("ret") * ppy**0.5).alias("volatility"),
        (F.avg("ret") * ppy).alias("_a"),
        _worst(ts).alias("_w"),
    )
    curve = curve.select("*", *_drawdown_columns("_w")).drop("_w")
    tail = conditional_var(rets, 0.95, keys=keys)
    done = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        _win_rate().alias("win_rate"),
        _profit_factor().alias("profit_factor"),
        _avg_win_loss().alias("avg_win_loss_ratio"),
    )
    on = list(keys)
    joined = curve.join(tail, on).join(done, on, "left")
    return joined.select(
        *keys,
        "total_return",
        _annual(F.col("total_return"), F.col("_n"), ppy).alias("annualized_return"),
        "sharpe_ratio",
        "sortino_ratio",
        F.when(F.col("max_drawdown") > 0, F.col("_a") / F.col("max_drawdown")).alias("calmar_ratio"),
        "max_drawdown",
        F.col("peak_ts").alias("max_drawdown_peak"),
        F.col("trough_ts").alias("max_drawdown_trough"),
        "volatility",
        F.col("var").alias("var_95"),
        F.col("cvar").alias("cvar_95"),
        F.coalesce("total_trades", F.lit(0)).alias("total_trades"),
        F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"),
        F.when(F.col("total_trades").isNull(), F.lit(0.0)).otherwise(F.col("profit_factor")).alias("profit_factor"),
        F.coalesce("avg_win_loss_ratio", F.lit(0.0)).alias("avg_win_loss_ratio"),
    )


def quick_metrics(
    rows: DataFrame,
    initial: float = 10_000.0,
    *,
    ret: str = "ret",
    keys: Keys = ("symbol",),
    ts: str = "ts",
    periods: int = 252,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Metrics of a next-bar run (``ret`` null when flat, ``equity`` compounded).

    Population deviation, and the drawdown is measured against the highest equity of the whole run.
    """
    run = running(rows, {"_peak": ("max", "equity")}, keys=keys, ts=ts)
    r = F.coalesce(F.col(ret), F.lit(0.0))
    facts = run.groupBy(*keys).agg(
        F.max_by("equity", ts).alias("final_equity"),
        (F.avg(r) * periods).alias("_ann"),
        (F.stddev_pop(r) * periods**0.5).alias("_vol"),
        F.max(F.col("_peak") - F.col("equity")).alias("_fall"),
        F.max("equity").alias("_top"),
        F.count(ret).alias("num_trades"),
        F.avg(F.when(F.col(ret).isNotNull(), (F.col(ret) > 0).cast("double"))).alias("_w"),
    )
    return facts.select(
        *keys,
        ((F.col("final_equity") / initial - 1) * 100).alias("total_return_pct"),
        F.when(F.col("_vol") > 0, F.col("_ann") / F.col("_vol")).otherwise(0.0).alias("sharpe_ratio"),
        (F.coalesce("_w", F.lit(0.0)) * 100).alias("win_rate_pct"),
        (F.col("_fall") / F.col("_top") * 100).alias("max_drawdown_pct"),
        "num_trades",
        "final_equity",
        (F.col("_ann") * 100).alias("annual_return_pct"),
        (F.col("_vol") * 100).alias("annual_volatility_pct"),
    )


def scan_summary(signals: DataFrame, *, keys: Keys = ()) -> DataFrame:
    """Totals of scanned signals; timeouts are counted apart and stay in the win-rate denominator."""
    o, p = F.col("outcome"), F.col("profit_loss")
    facts = signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_signals"),
        F.count_if(o == "Win").alias("won_trades"),
        F.count_if(o == "Loss").alias("lost_trades"),
        F.count_if(o == "Pending").alias("pending_trades"),
        F.count_if(o == "Timeout").alias("timeout_trades"),
        F.coalesce(F.sum(p), F.lit(0.0)).alias("total_profit_loss"),
        F.coalesce(F.avg(F.when(o == "Win", p)), F.lit(0.0)).alias("average_win"),
        F.coalesce(F.avg(F.when(o == "Loss", p)), F.lit(0.0)).alias("average_loss"),
        F.count_if(p > 0).alias("_profitable"),
    )
    return facts.withColumns(
        {
            "win_rate": F.coalesce(F.try_divide(F.col("won_trades"), F.col("total_signals")), F.lit(0.0)),
            "profitability_rate": F.coalesce(F.try_divide(F.col("_profitable"), F.col("total_signals")), F.lit(0.0)),
        }
    ).drop("_profitable")
