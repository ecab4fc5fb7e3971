"""Queries on trades, equity, metrics and analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.catalog.base import H_SQL, O, P_SQL, S_SQL, hourly, predictions, query, rows, shipped, table
from barspark.catalog.decisions import _REG, regime_rows
from barspark.catalog.labels import _SCAN_SQL, _TR, scanned
from barspark.functions import sizing as Z
from barspark.functions import indicators as I
from barspark.operators import analytics as A
from barspark.operators import metrics as M
from barspark.operators import trades as K

START = 1_000_000.0
SK = ("strategy",)

# -- signals to trades -----------------------------------------------------------------------------

query("candidate_signals", f"WITH {P_SQL} SELECT event_id FROM p WHERE prediction = 1 AND probability >= 0.6")(
    lambda spark, d: K.candidate_signals(predictions(spark, d), 0.6).select("event_id")
)


def _trade_input(spark, d):
    """Hourly bars with ATR as predictions: the last tick's value decides."""
    out = I.atr(hourly(spark, d), 14, out="atr")
    p = F.round(F.least(F.col("close") / 200, F.lit(1.0)), 6)
    return out.select("symbol", "ts", "close", "atr", p.alias("probability"), (p >= 0.2).cast("int").alias("prediction"))


# One position at a time, followed signal by signal in SQL: each step looks up the next free signal.
_CAND = f"""{H_SQL}, {_TR}, pr AS (SELECT symbol, ts, close, atr, round(least(close / 200, 1.0), 6) AS probability FROM ha),
  cd AS (SELECT symbol, ts, close, probability, CASE WHEN atr IS NULL THEN close * 0.999::DOUBLE ELSE close - atr END AS sl,
  CASE WHEN atr IS NULL THEN close * 1.002::DOUBLE ELSE close + 1.8::DOUBLE * atr END AS tp FROM pr WHERE probability >= 0.2),
  fx AS (SELECT cd.symbol, cd.ts, min(b.ts) AS exit_ts FROM cd JOIN h b ON b.symbol = cd.symbol AND b.ts > cd.ts
  AND (b.low <= cd.sl OR b.high >= cd.tp) GROUP BY 1, 2),
  ex AS (SELECT cd.*, fx.exit_ts, CASE WHEN b.low <= sl AND b.high >= tp THEN abs(b.open - tp) < abs(b.open - sl) ELSE b.high >= tp END AS is_win
  FROM cd JOIN fx USING (symbol, ts) JOIN h b ON b.symbol = cd.symbol AND b.ts = fx.exit_ts)"""


def _taken_sql(cap: int | None = None) -> str:
    if cap is None:
        step = """SELECT n.symbol, n.ts, n.exit_ts FROM walk w JOIN LATERAL
          (SELECT * FROM ex WHERE ex.symbol = w.symbol AND ex.ts >= w.exit_ts ORDER BY ex.ts LIMIT 1) n ON true"""
        return f"""WITH RECURSIVE {_CAND}, walk AS (SELECT symbol, min(ts) AS ts, arg_min(exit_ts, ts) AS exit_ts FROM ex GROUP BY 1
          UNION ALL {step}), tk AS (SELECT ex.* FROM ex JOIN walk USING (symbol, ts))"""
    step = f"""SELECT n.symbol, n.ts, n.exit_ts, CASE WHEN n.ts::DATE = w.ts::DATE THEN w.used + 1 ELSE 1 END AS used FROM walk w
      JOIN LATERAL (SELECT * FROM ex WHERE ex.symbol = w.symbol AND ex.ts >= w.exit_ts
      AND (w.used < {cap} OR ex.ts::DATE > w.ts::DATE) ORDER BY ex.ts LIMIT 1) n ON true"""
    return f"""WITH RECURSIVE {_CAND}, walk AS (SELECT symbol, min(ts) AS ts, arg_min(exit_ts, ts) AS exit_ts, 1 AS used FROM ex GROUP BY 1
      UNION ALL {step}), tk AS (SELECT ex.* FROM ex JOIN walk USING (symbol, ts))"""


def _taken(spark, d, cap=None, chunk_rows=None):
    p = _trade_input(spark, d)
    return K.take_trades(p, hourly(spark, d), min_probability=0.2, max_per_day=cap, chunk_rows=chunk_rows)


for _name, _cap, _rows in (
    ("non_overlapping", None, None),
    ("non_overlapping_chunked", None, 30),
    ("non_overlapping_capped", 2, None),
    ("non_overlapping_capped_chunked", 2, 30),
):
    query(_name, _taken_sql(_cap) + " SELECT symbol, ts, exit_ts, is_win FROM tk")(
        lambda spark, d, c=_cap, r=_rows: _taken(spark, d, c, r).select("symbol", "ts", "exit_ts", "is_win")
    )

_PNL = """pn AS (SELECT *, close AS entry_price, CASE WHEN is_win THEN tp ELSE sl END AS exit_price,
  0.01::DOUBLE * (CASE WHEN is_win THEN tp ELSE sl END - close) AS gross_pnl, 0.8::DOUBLE AS transaction_cost,
  0.01::DOUBLE * (CASE WHEN is_win THEN tp ELSE sl END - close) - 0.8::DOUBLE AS pnl,
  epoch(exit_ts - ts) / 60 AS duration_minutes FROM tk)"""
_T = "symbol, ts, exit_ts, is_win, entry_price, exit_price, gross_pnl, transaction_cost, pnl, duration_minutes"
query(
    "trade_pnl",
    f"{_taken_sql()}, {_PNL} SELECT {_T} FROM pn",
    "entry_price exit_price gross_pnl transaction_cost pnl duration_minutes",
)(lambda spark, d: _taken(spark, d).select(*_T.split(", ")))

_FIRSTK = "SELECT event_id FROM p WHERE prediction = 1 QUALIFY row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) <= 3"
query("first_k_per_day", f"WITH {P_SQL} {_FIRSTK}")(
    lambda spark, d: K.first_k_per_day(predictions(spark, d).where("prediction = 1"), 3).select("event_id")
)


def _equity_sql() -> str:
    return f"""{_taken_sql()}, {_PNL}, pt AS (SELECT pr.symbol, pr.ts, pn.exit_ts, pn.pnl FROM pr LEFT JOIN pn USING (symbol, ts)),
    rn AS (SELECT *, max(exit_ts) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS busy,
    sum(pnl) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS won FROM pt),
    kp AS (SELECT * FROM rn WHERE exit_ts IS NOT NULL OR busy IS NULL OR ts >= busy),
    eq AS (SELECT symbol, row_number() OVER {O} AS seq, ts, 1000.0::DOUBLE + coalesce(won, 0) AS equity FROM kp
    UNION ALL SELECT symbol, 0, min(ts), 1000.0::DOUBLE FROM pr GROUP BY 1)"""


def _equity(spark, d, chunk_rows=None):
    p = _trade_input(spark, d)
    trades = K.take_trades(p, hourly(spark, d), min_probability=0.2, chunk_rows=chunk_rows)
    return K.equity_curve(p, trades, 1000.0, chunk_rows=chunk_rows)


for _name, _rows in (("equity_curve", None), ("equity_curve_chunked", 60)):
    query(_name, _equity_sql() + " SELECT symbol, seq, ts, equity FROM eq", "equity")(
        lambda spark, d, r=_rows: _equity(spark, d, r)
    )

query(
    "drawdown_stop",
    _equity_sql()
    + f""", dk AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS peak FROM eq),
    st AS (SELECT symbol, min(seq) AS stop FROM dk WHERE (peak - equity) / peak >= 0.05 GROUP BY 1)
    SELECT dk.symbol, seq, ts, equity FROM dk LEFT JOIN st USING (symbol) WHERE stop IS NULL OR seq <= stop""",
    "equity",
)(lambda spark, d: K.drawdown_stop(_equity(spark, d), 0.05).select("symbol", "seq", "ts", "equity"))

_STOPPED = f"""{_equity_sql()}, dk AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS peak FROM eq),
    st AS (SELECT symbol, arg_min(ts, seq) AS stop_ts FROM dk WHERE (peak - equity) / peak >= 0.002 GROUP BY 1)"""


@query("stop_trading", f"{_STOPPED} SELECT symbol, ts, exit_ts, pnl FROM pn LEFT JOIN st USING (symbol) WHERE stop_ts IS NULL OR ts <= stop_ts", "pnl")
def _stopped(spark, d):
    p = _trade_input(spark, d)
    trades = K.take_trades(p, hourly(spark, d), min_probability=0.2)
    return K.stop_trading(trades, K.equity_curve(p, trades, 1000.0), 0.002).select("symbol", "ts", "exit_ts", "pnl")


def _compound_sql(initial: float, per_price: float, cost: float) -> str:
    rest = lambda c: f"CASE WHEN {c} > 0 THEN greatest(0.0::DOUBLE, {c} * (1 + nm.u * nm.mv) - {cost}::DOUBLE) ELSE 0.0::DOUBLE END"
    return f"""{_taken_sql()}, {_PNL},
    nm AS (SELECT symbol, ts, row_number() OVER {O} AS i, {per_price}::DOUBLE / close AS u, exit_price - close AS mv FROM pn),
    cp AS (SELECT symbol, i, ts, u, {initial}::DOUBLE AS capital, {rest(f"{initial}::DOUBLE")} AS rest FROM nm WHERE i = 1
    UNION ALL SELECT nm.symbol, nm.i, nm.ts, nm.u, cp.rest, {rest("cp.rest")} FROM cp JOIN nm ON nm.symbol = cp.symbol AND nm.i = cp.i + 1)
    SELECT symbol, ts, capital, u * capital AS position_size, rest - capital AS pnl FROM cp"""


for _name, _rows in (("compound_trades", None), ("compound_trades_chunked", 30)):
    query(_name, _compound_sql(1000.0, 0.01, 0.8), "capital position_size pnl")(
        lambda spark, d, r=_rows: K.compound_trades(_taken(spark, d), 0.01 / F.col("entry_price"), 1000.0, chunk_rows=r).select(
            "symbol", "ts", "capital", "position_size", "pnl"
        )
    )


# Costs eat the capital up: the trade that takes the last of it is the last one.
@query("compound_trades_ruin", _compound_sql(10.0, 0.5, 1.3), "capital position_size pnl")
def _ruined(spark, d):
    return K.compound_trades(_taken(spark, d), 0.5 / F.col("entry_price"), 10.0, cost=1.3).select("symbol", "ts", "capital", "position_size", "pnl")


_SCN = [(s.name, s.spread, s.commission, s.threshold) for s in K.stress_scenarios(0.3)]


def _stress_sql(cap: int | None) -> str:
    vals = ", ".join(f"('{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for n, a, b, c in _SCN)
    fired = "true" if cap is None else f"row_number() OVER (PARTITION BY scenario, symbol, ts::DATE, probability >= threshold ORDER BY ts) <= {cap}"
    return f"""{H_SQL}, sc AS (SELECT * FROM (VALUES {vals}) v(scenario, spread, commission, threshold)),
    b AS (SELECT symbol, ts, close, lead(close) OVER {O} AS nx, round(least(close / 200, 1.0), 6) AS probability FROM h),
    j AS (SELECT *, {fired} AS ok FROM b, sc),
    r AS (SELECT scenario, symbol, ts, CASE WHEN probability >= threshold AND nx IS NOT NULL AND ok
      THEN nx * ((1 - spread / 2) * (1 - commission)) / (close * ((1 + spread / 2) * (1 + commission))) - 1 END AS ret FROM j),
    ce AS (SELECT *, 10000 * exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY scenario, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS equity FROM r)"""


def _stress(spark, d, cap=None, chunk_rows=None):
    p = F.round(F.least(F.col("close") / 200, F.lit(1.0)), 6)
    bars = hourly(spark, d).withColumn("probability", p)
    return K.stress(bars, K.stress_scenarios(0.3), max_per_day=cap, chunk_rows=chunk_rows)


# Compounded hourly losses of this data fall far below a cent: the log of equity is compared.
for _name, _cap, _rows in (("stress", None, None), ("stress_capped", 2, None), ("stress_chunked", None, 200)):
    query(_name, f"WITH {_stress_sql(_cap)} SELECT scenario, symbol, ts, ret, ln(equity) AS log_equity FROM ce", "ret log_equity", 5)(
        lambda spark, d, c=_cap, r=_rows: _stress(spark, d, c, r).select(
            "scenario", "symbol", "ts", "ret", F.ln("equity").alias("log_equity")
        )
    )

_QM = "total_return_pct sharpe_ratio win_rate_pct max_drawdown_pct final_equity annual_return_pct annual_volatility_pct"
query(
    "quick_metrics",
    f"""WITH {_stress_sql(None)}, pk AS (SELECT *, max(equity) OVER (PARTITION BY scenario, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM ce),
    a AS (SELECT scenario, symbol, arg_max(equity, ts) AS final_equity, avg(coalesce(ret, 0)) * 252 AS ann,
    stddev_pop(coalesce(ret, 0)) * sqrt(252) AS vol, max(peak - equity) AS fall, max(equity) AS top, count(ret) AS num_trades,
    avg((ret > 0)::INTEGER) AS w FROM pk GROUP BY 1, 2)
    SELECT scenario, symbol, (final_equity / 10000 - 1) * 100 AS total_return_pct, ann / vol AS sharpe_ratio, w * 100 AS win_rate_pct,
    fall / top * 100 AS max_drawdown_pct, num_trades, final_equity, ann * 100 AS annual_return_pct, vol * 100 AS annual_volatility_pct FROM a""",
    _QM,
    3,
)(lambda spark, d: M.quick_metrics(_stress(spark, d), keys=("scenario", "symbol")))


@query(
    "compound_equity",
    f"""WITH {S_SQL}, dy AS (SELECT strategy, ts, sum(pnl) / 1e7 AS ret FROM s GROUP BY 1, 2)
    SELECT strategy, ts, 10000 * exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS equity FROM dy""",
    "equity",
    4,
)
def _compound(spark, d):
    daily = shipped(spark, d).groupBy("strategy", "ts").agg((F.sum("pnl") / 1e7).alias("ret"))
    return K.compound_equity(daily, keys=SK).select("strategy", "ts", "equity")


_SCANNED_ROWS = f"""WITH {H_SQL}, {_TR} SELECT symbol, ts FROM hi WHERE i >= 119 AND (i - 119) % 6 = 0 AND hour(ts) >= 8 AND hour(ts) < 22
  AND close / 200 >= 0.2"""


@query("scan_signals", _SCANNED_ROWS)
def _scan(spark, d):
    p = _trade_input(spark, d)
    return K.scan_signals(p.withColumn("threshold", F.lit(0.2)), step=6, window=-80, fine_per_bar=1, min_candles=120).select("symbol", "ts")


_DAYS = "{ts} >= t0 + INTERVAL 5 DAY + k * INTERVAL 4 DAY AND {ts} < t0 + INTERVAL 9 DAY + k * INTERVAL 4 DAY"


@query(
    "walk_forward_trades",
    f"""WITH RECURSIVE {_CAND}, b0 AS (SELECT symbol, min(ts) AS t0, max(ts) AS t1 FROM h GROUP BY 1),
    wn AS (SELECT symbol, t0, unnest(range(20)) AS k, t1 FROM b0),
    we AS (SELECT ex.*, k AS window_id FROM ex JOIN wn USING (symbol) WHERE {_DAYS.format(ts="ex.ts")} AND t0 + k * INTERVAL 4 DAY < t1),
    walk AS (SELECT symbol, window_id, min(ts) AS ts, arg_min(exit_ts, ts) AS exit_ts FROM we GROUP BY 1, 2
    UNION ALL SELECT n.symbol, n.window_id, n.ts, n.exit_ts FROM walk w JOIN LATERAL (SELECT * FROM we WHERE we.symbol = w.symbol
    AND we.window_id = w.window_id AND we.ts >= w.exit_ts ORDER BY we.ts LIMIT 1) n ON true)
    SELECT symbol, window_id, ts, exit_ts FROM walk""",
)
def _wf_trades(spark, d):
    return K.walk_forward_trades(
        _trade_input(spark, d), hourly(spark, d), train_days=5, test_days=4, step_days=4, min_probability=0.2
    ).select("symbol", "window_id", "ts", "exit_ts")


@query(
    "position_size",
    """SELECT l_orderkey, l_linenumber, m AS method, greatest(0.01::DOUBLE, least(size, 1.0::DOUBLE)) AS size FROM (
    SELECT l_orderkey, l_linenumber, m, CASE m WHEN 'fixed' THEN 0.01::DOUBLE WHEN 'risk_based' THEN l_extendedprice * 0.01::DOUBLE / l_quantity
    WHEN 'kelly' THEN CASE WHEN (l_discount * 10 - (1 - l_discount * 10) * 50 / (l_quantity * 5)) * 0.25::DOUBLE <= 0 THEN 0.01::DOUBLE
    ELSE (l_discount * 10 - (1 - l_discount * 10) * 50 / (l_quantity * 5)) * 0.25::DOUBLE * l_extendedprice / 10000 END
    ELSE 0.01::DOUBLE * 0.01::DOUBLE / (l_tax + 0.001::DOUBLE) END AS size
    FROM lineitem, (VALUES ('fixed'), ('risk_based'), ('kelly'), ('volatility_based')) v(m))""",
    "size",
)
def _size(spark, d):
    li = table(spark, d, "lineitem").withColumn("method", F.explode(F.array(*[F.lit(m) for m in Z.METHODS])))
    size = Z.position_size(
        F.col("method"),
        capital=F.col("l_extendedprice"),
        stop_pips=F.col("l_quantity"),
        win_rate=F.col("l_discount") * 10,
        avg_win=F.col("l_quantity") * 5,
        avg_loss=F.lit(50.0),
        volatility=F.col("l_tax") + 0.001,
    )
    return li.select("l_orderkey", "l_linenumber", "method", size.alias("size"))


query(
    "pip_value",
    "SELECT l_orderkey, l_linenumber, l_quantity * 100 AS pip_value, l_tax * 100 AS units FROM lineitem",
    "pip_value units",
)(
    lambda spark, d: table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        Z.pip_value(F.col("l_quantity")).alias("pip_value"),
        Z.lots_to_units(F.col("l_tax")).alias("units"),
    )
)

# -- metrics ---------------------------------------------------------------------------------------

_ES = f"""{S_SQL}, pd AS (SELECT strategy, ts, sum(pnl) AS pnl FROM s GROUP BY 1, 2),
  eq AS (SELECT strategy, row_number() OVER w AS seq, ts, {START!r}::DOUBLE + sum(pnl) OVER (w ROWS UNBOUNDED PRECEDING) AS equity FROM pd
  WINDOW w AS (PARTITION BY strategy ORDER BY ts) UNION ALL SELECT strategy, 0, min(ts), {START!r}::DOUBLE FROM pd GROUP BY 1),
  rt AS (SELECT *, coalesce(equity / lag(equity) OVER (PARTITION BY strategy ORDER BY seq) - 1, 0) AS ret,
  max(equity) OVER (PARTITION BY strategy ORDER BY seq ROWS UNBOUNDED PRECEDING) AS peak FROM eq)"""


def _daily(spark, d):
    return shipped(spark, d).groupBy("strategy", "ts").agg(F.sum("pnl").alias("pnl"))


def _curve(spark, d, chunk_rows=None):
    return K.trade_equity(_daily(spark, d), START, keys=SK, chunk_rows=chunk_rows)


def _rets(spark, d, chunk_rows=None):
    return M.returns(_curve(spark, d, chunk_rows), keys=SK, chunk_rows=chunk_rows)


for _name, _rows in (("returns", None), ("returns_chunked", 300)):
    query(_name, f"WITH {_ES} SELECT strategy, seq, equity, ret FROM rt", "equity ret", 5)(
        lambda spark, d, r=_rows: _rets(spark, d, r).select("strategy", "seq", "equity", "ret")
    )
query("total_return", f"WITH {_ES} SELECT strategy, (arg_max(equity, seq) - {START}) / {START} AS total_return FROM rt GROUP BY 1", "total_return")(
    lambda spark, d: M.total_return(_curve(spark, d), START, keys=SK)
)
query(
    "annualized_return",
    f"""WITH {_ES} SELECT strategy, pow(1 + (arg_max(equity, seq) - {START}) / {START}, 252::DOUBLE / count(*)) - 1 AS annualized_return
    FROM rt GROUP BY 1""",
    "annualized_return",
)(lambda spark, d: M.annualized_return(_curve(spark, d), START, 252, keys=SK))
query(
    "sharpe",
    f"WITH {_ES} SELECT strategy, (avg(ret) - 0.045::DOUBLE / 252) / stddev_samp(ret) * sqrt(252) AS sharpe_ratio FROM rt GROUP BY 1",
    "sharpe_ratio",
)(lambda spark, d: M.sharpe_ratio(_rets(spark, d), 0.045, 252, keys=SK))
query(
    "sortino",
    f"""WITH {_ES} SELECT strategy, (avg(ret) - 0.045::DOUBLE / 252) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS sortino_ratio
    FROM rt GROUP BY 1""",
    "sortino_ratio",
)(lambda spark, d: M.sortino_ratio(_rets(spark, d), 0.045, 252, keys=SK))

_DD = """dd AS (SELECT strategy, max((peak - equity) / peak) AS max_drawdown FROM rt GROUP BY 1),
  tr AS (SELECT rt.strategy, arg_min(rt.ts, rt.seq) AS trough_ts, min(rt.seq) AS tseq, arg_min(rt.peak, rt.seq) AS peak FROM rt JOIN dd
  ON rt.strategy = dd.strategy AND (rt.peak - rt.equity) / rt.peak = dd.max_drawdown GROUP BY 1),
  pk AS (SELECT rt.strategy, arg_min(rt.ts, rt.seq) AS peak_ts FROM rt JOIN tr ON rt.strategy = tr.strategy AND rt.equity = tr.peak
  AND rt.seq <= tr.tseq GROUP BY 1)"""
for _name, _rows in (("drawdown", None), ("drawdown_chunked", 300)):
    query(
        _name,
        f"WITH {_ES}, {_DD} SELECT strategy, max_drawdown, peak_ts, trough_ts FROM dd JOIN tr USING (strategy) JOIN pk USING (strategy)",
        "max_drawdown",
    )(lambda spark, d, r=_rows: M.max_drawdown(_curve(spark, d, r), keys=SK, chunk_rows=r))
query(
    "calmar",
    f"""WITH {_ES}, {_DD}, m AS (SELECT strategy, avg(ret) * 252 AS a FROM rt GROUP BY 1)
    SELECT strategy, a / max_drawdown AS calmar_ratio FROM m JOIN dd USING (strategy)""",
    "calmar_ratio",
)(lambda spark, d: M.calmar_ratio(_rets(spark, d), _curve(spark, d), keys=SK))

_VAR = """vr AS (SELECT strategy, greatest(0, -quantile_cont(ret, 0.05)) AS var FROM rt GROUP BY 1),
  cv AS (SELECT rt.strategy, -avg(ret) AS c FROM rt JOIN vr USING (strategy) WHERE ret <= -var GROUP BY 1)"""
query("var_cvar", f"WITH {_ES}, {_VAR} SELECT strategy, var, coalesce(c, var) AS cvar FROM vr LEFT JOIN cv USING (strategy)", "var cvar", 7)(
    lambda spark, d: M.conditional_var(_rets(spark, d), 0.95, keys=SK)
)
query("win_rate", f"WITH {S_SQL} SELECT strategy, avg((pnl > 0)::INTEGER) AS win_rate FROM s GROUP BY 1", "win_rate")(
    lambda spark, d: M.win_rate(shipped(spark, d), keys=SK)
)
query(
    "profit_factor",
    f"""WITH {S_SQL} SELECT strategy, sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl < 0)) AS profit_factor, false AS no_losses
    FROM s GROUP BY 1""",
    "profit_factor",
)(lambda spark, d: M.profit_factor(shipped(spark, d), keys=SK))
query(
    "avg_win_loss",
    f"WITH {S_SQL} SELECT strategy, avg(pnl) FILTER (pnl > 0) / abs(avg(pnl) FILTER (pnl < 0)) AS avg_win_loss_ratio FROM s GROUP BY 1",
    "avg_win_loss_ratio",
)(lambda spark, d: M.avg_win_loss(shipped(spark, d), keys=SK))

_ALL = "total_return annualized_return sharpe_ratio sortino_ratio calmar_ratio max_drawdown volatility var_95 cvar_95 win_rate profit_factor avg_win_loss_ratio"
query(
    "all_metrics",
    f"""WITH {_ES}, {_DD}, {_VAR}, a AS (SELECT strategy, (arg_max(equity, seq) - {START}) / {START} AS total_return, count(*) AS n,
    (avg(ret) - 0.02::DOUBLE / 252) / stddev_samp(ret) * sqrt(252) AS sharpe_ratio,
    (avg(ret) - 0.02::DOUBLE / 252) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS sortino_ratio,
    stddev_samp(ret) * sqrt(252) AS volatility, avg(ret) * 252 AS m FROM rt GROUP BY 1),
    t AS (SELECT strategy, count(*) AS total_trades, avg((pnl > 0)::INTEGER) AS win_rate,
    sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl < 0)) AS profit_factor,
    avg(pnl) FILTER (pnl > 0) / abs(avg(pnl) FILTER (pnl < 0)) AS avg_win_loss_ratio FROM s GROUP BY 1)
    SELECT strategy, total_return, pow(1 + total_return, 252::DOUBLE / n) - 1 AS annualized_return, sharpe_ratio, sortino_ratio,
    m / max_drawdown AS calmar_ratio, max_drawdown, peak_ts AS max_drawdown_peak, trough_ts AS max_drawdown_trough, volatility,
    var AS var_95, coalesce(c, var) AS cvar_95, total_trades, win_rate, profit_factor, avg_win_loss_ratio
    FROM a JOIN dd USING (strategy) JOIN tr USING (strategy) JOIN pk USING (strategy) JOIN vr USING (strategy)
    LEFT JOIN cv USING (strategy) JOIN t USING (strategy)""",
    _ALL,
)(lambda spark, d: M.all_metrics(_curve(spark, d), shipped(spark, d), START, 252, 0.02, keys=SK))

query(
    "scan_summary",
    _SCAN_SQL
    + """ SELECT symbol, count(*) AS total_signals, count(*) FILTER (outcome = 'Win') AS won_trades, count(*) FILTER (outcome = 'Loss') AS lost_trades,
    count(*) FILTER (outcome = 'Pending') AS pending_trades, count(*) FILTER (outcome = 'Timeout') AS timeout_trades,
    sum(profit_loss) AS total_profit_loss, avg(profit_loss) FILTER (outcome = 'Win') AS average_win,
    coalesce(avg(profit_loss) FILTER (outcome = 'Loss'), 0) AS average_loss, count(*) FILTER (outcome = 'Win') / count(*) AS win_rate,
    count(*) FILTER (profit_loss > 0) / count(*) AS profitability_rate FROM scanned GROUP BY 1""",
    "total_profit_loss average_win average_loss win_rate profitability_rate",
)(lambda spark, d: M.scan_summary(scanned(spark, d), keys=("symbol",)))

# -- analytics -------------------------------------------------------------------------------------

_FEATS = ("close", "atr_m5", "adx", "sma_200", "probability")
_LONG = "lf AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS v, label FROM rg" for f in _FEATS) + ")"
_BAND = "CASE WHEN abs(corr) > 0.05 THEN 'STRONG' WHEN abs(corr) > 0.01 THEN 'WEAK' ELSE 'NONE' END"
_CORR = f"{H_SQL}, {_REG}, {_LONG}, cr AS (SELECT feature, corr(v, label) AS corr FROM lf GROUP BY 1)"
query("corr_rank", f"WITH {_CORR} SELECT feature, corr, abs(corr) AS abs_corr, {_BAND} AS strength FROM cr", "corr abs_corr")(
    lambda spark, d: A.corr_rank(regime_rows(spark, d), _FEATS)
)
query(
    "conditional_means",
    f"""WITH {H_SQL}, {_REG}, {_LONG} SELECT feature, avg(v) FILTER (label = 1) AS mean_pos, avg(v) FILTER (label = 0) AS mean_neg,
    stddev_samp(v) AS std, var_samp(v) AS variance, 100.0 * avg((v = 0)::INTEGER) AS zero_pct,
    abs(avg(v) FILTER (label = 1) - avg(v) FILTER (label = 0)) AS signal_diff FROM lf GROUP BY 1""",
    "mean_pos mean_neg std variance zero_pct signal_diff",
    5,
)(lambda spark, d: A.conditional_means(regime_rows(spark, d), _FEATS))
_FAMILY = {"close": "price", "sma_200": "price", "atr_m5": "range", "adx": "trend", "probability": "price"}
query(
    "family_rollup",
    f"""WITH {_CORR}, fm AS (SELECT CASE feature WHEN 'atr_m5' THEN 'range' WHEN 'adx' THEN 'trend' ELSE 'price' END AS family, abs(corr) AS a FROM cr)
    SELECT family, max(a) AS max_corr, avg(a) AS mean_corr, min(a) AS min_corr, count(*) AS n_features FROM fm GROUP BY 1""",
    "max_corr mean_corr min_corr",
)(lambda spark, d: A.family_rollup(A.corr_rank(regime_rows(spark, d), _FEATS), _FAMILY))
query(
    "top_bottom",
    f"""WITH {_CORR} (SELECT feature, abs(corr) AS abs_corr, 'top' AS side FROM cr ORDER BY 2 DESC, 1 LIMIT 3)
    UNION ALL (SELECT feature, abs(corr), 'bottom' FROM cr ORDER BY 2, 1 LIMIT 2)""",
    "abs_corr",
)(lambda spark, d: A.top_bottom(A.corr_rank(regime_rows(spark, d), _FEATS), "abs_corr", 3, 2).select("feature", "abs_corr", "side"))


@query(
    "problem_features",
    """WITH a AS (SELECT var_samp(l_discount) AS v1, 100.0 * avg((l_discount = 0)::INTEGER) AS z1, var_samp(l_tax) AS v2,
    100.0 * avg((l_tax = 0)::INTEGER) AS z2, var_samp(l_quantity) AS v3, 100.0 * avg((l_quantity = 0)::INTEGER) AS z3 FROM lineitem)
    SELECT feature FROM (SELECT 'l_discount' AS feature, v1 AS v, z1 AS z FROM a UNION ALL SELECT 'l_tax', v2, z2 FROM a
    UNION ALL SELECT 'l_quantity', v3, z3 FROM a) WHERE v < 0.001 OR z > 50""",
)
def _problems(spark, d):
    li = table(spark, d, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return A.problem_features(A.conditional_means(li, ["l_discount", "l_tax", "l_quantity"])).select("feature")


_LI = ("l_quantity", "l_extendedprice", "l_discount")
_DRIFT = "mean std p1 p50 p99 ref_center ref_scale z_shift"
_OLD, _NEW = "l_shipdate < TIMESTAMP '1998-01-01'", "l_shipdate >= TIMESTAMP '1998-01-01'"
_DRIFT_SQL = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, n.mean, n.std, n.p1, n.p50, n.p99, o.c AS ref_center, o.s AS ref_scale, (n.mean - o.c) / o.s AS z_shift,
    abs((n.mean - o.c) / o.s) > 3 AS drifted FROM (SELECT avg({f}) AS mean, stddev_pop({f}) AS std, quantile_cont({f}, 0.01) AS p1,
    quantile_cont({f}, 0.5) AS p50, quantile_cont({f}, 0.99) AS p99 FROM lineitem WHERE {_NEW}) n,
    (SELECT quantile_cont({f}, 0.5) AS c, quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) AS s FROM lineitem WHERE {_OLD}) o"""
    for f in _LI
)


@query("drift", _DRIFT_SQL, _DRIFT, 4)
def _drift(spark, d):
    li = table(spark, d, "lineitem")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return A.drift(li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut), _LI)


_QT = "0.05, 0.25, 0.5, 0.9"
_QUANT_SQL = " UNION ALL ".join(
    f"SELECT l_returnflag, {p}::DOUBLE AS prob, quantile_cont(l_extendedprice, {p}) AS q FROM lineitem GROUP BY 1" for p in _QT.split(", ")
)
for _name in ("exact_quantiles", "exact_quantiles_ranges"):
    query(_name, _QUANT_SQL, "q", 4)(
        lambda spark, d: A.exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.05, 0.25, 0.5, 0.9], keys=["l_returnflag"])
    )


def _graded(spark, d):
    return scanned(spark, d).withColumn("probability", F.round(F.least(F.col("entry_price") / 200, F.lit(1.0)), 6))


_GRADED = _SCAN_SQL + ", gd AS (SELECT *, round(least(entry_price / 200, 1.0), 6) AS probability FROM scanned)"
query(
    "outcome_by_probability",
    _GRADED
    + """ SELECT outcome, count(*) AS n, avg(probability) AS mean_p, count(*) FILTER (outcome = 'Loss' AND probability > 0.7) AS high_p_losses,
    quantile_cont(probability, 0.5) AS median_p FROM gd WHERE probability IS NOT NULL GROUP BY 1""",
    "mean_p median_p",
)(lambda spark, d: A.outcome_by_probability(_graded(spark, d).where("probability IS NOT NULL")))
query("outcome_by_atr", _SCAN_SQL + " SELECT outcome, avg(atr) AS mean_atr, count(atr) AS n FROM scanned GROUP BY 1", "mean_atr")(
    lambda spark, d: A.outcome_by_atr(scanned(spark, d))
)
query("hour_hist", "SELECT hour(ts)::INTEGER AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")(
    lambda spark, d: A.hour_histogram(table(spark, d, "events"), 5)
)

_RUNS = f"""{P_SQL}, o1 AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS n_trade, ts, probability, label FROM p WHERE probability >= 0.5),
  o2 AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS n_trade, ts, probability, label FROM p WHERE probability >= 0.52)"""


def _run(spark, d, t):
    p = predictions(spark, d).where(F.col("probability") >= t)
    return p.select(
        "ts", "event_id", "probability", (F.col("label") * 2.0 - 1).alias("pnl"), (F.col("label") == 1).alias("is_win"),
        (F.col("label") * 2.0).alias("gross_pnl"),
    )


def _compared(spark, d, chunk_rows=None):
    return A.compare_runs(_run(spark, d, 0.5), _run(spark, d, 0.52), ("probability",), tie=("event_id",), chunk_rows=chunk_rows)


for _name, _rows in (("compare_runs", None), ("compare_runs_chunked", 200)):
    query(
        _name,
        f"""WITH {_RUNS} SELECT n_trade, o1.ts AS old_ts, o2.ts AS new_ts, o1.probability AS old_probability, o2.probability AS new_probability,
        o1.ts IS NOT DISTINCT FROM o2.ts AS same_ts, o1.probability IS NOT DISTINCT FROM o2.probability AS same_probability,
        (o2.label - o1.label) * 2.0::DOUBLE AS pnl_diff FROM o1 FULL JOIN o2 USING (n_trade)""",
        "old_probability new_probability pnl_diff",
    )(
        lambda spark, d, r=_rows: _compared(spark, d, r).select(
            "n_trade", "old_ts", "new_ts", "old_probability", "new_probability", "same_ts", "same_probability", "pnl_diff"
        )
    )
query(
    "comparison_summary",
    f"""WITH {_RUNS}, j AS (SELECT o1.ts AS a, o2.ts AS b, o1.probability AS pa, o2.probability AS pb, (o2.label - o1.label) * 2.0 AS df
    FROM o1 FULL JOIN o2 USING (n_trade)) SELECT count(a) AS n_old, count(b) AS n_new, bool_and(a IS NOT DISTINCT FROM b) AS all_same_ts,
    bool_and(pa IS NOT DISTINCT FROM pb) AS all_same_probability, sum(df)::DOUBLE AS pnl_diff FROM j""",
    "pnl_diff",
)(lambda spark, d: A.comparison_summary(_compared(spark, d), cols=("probability",)))
query(
    "run_totals",
    f"""WITH {P_SQL} SELECT count(*) AS n_trades, 100.0 * avg(label) AS win_pct, sum(label * 2.0 - 1)::DOUBLE AS total_pnl,
    avg(label * 2.0) AS mean_gross FROM p WHERE probability >= 0.5""",
    "win_pct total_pnl mean_gross",
)(lambda spark, d: A.run_totals(_run(spark, d, 0.5)))

_SUM = "win_pct mean_duration total_pnl mean_pnl mean_invested mean_roi_pct"
query(
    "trade_summary",
    f"""{_taken_sql()}, {_PNL} SELECT symbol, count(*) AS n_trades, count(*) FILTER (is_win) AS n_wins, count(*) FILTER (NOT is_win) AS n_losses,
    100.0 * avg(is_win::INTEGER) AS win_pct, avg(duration_minutes) AS mean_duration, sum(pnl) AS total_pnl, avg(pnl) AS mean_pnl,
    avg(0.01::DOUBLE * entry_price) AS mean_invested, 100.0 * avg(pnl / (0.01::DOUBLE * entry_price)) AS mean_roi_pct FROM pn GROUP BY 1""",
    _SUM,
    5,
)(lambda spark, d: A.trade_summary(_taken(spark, d), keys=("symbol",)))
query(
    "recovered_levels",
    f"""{_taken_sql()}, {_PNL} SELECT symbol, ts, gross_pnl / (0.01::DOUBLE * 1.8::DOUBLE) AS implied_atr,
    entry_price - gross_pnl / (0.01::DOUBLE * 1.8::DOUBLE) AS sl_price, entry_price + 1.8::DOUBLE * gross_pnl / (0.01::DOUBLE * 1.8::DOUBLE) AS tp_price FROM pn""",
    "implied_atr sl_price tp_price",
)(lambda spark, d: A.recovered_levels(_taken(spark, d)).select("symbol", "ts", "implied_atr", "sl_price", "tp_price"))

_BE = "atr_mean atr_std atr_min atr_max atr_median net_tp net_sl break_even_win_rate min_size min_tp_multiplier expected_pnl"
query(
    "break_even",
    f"""WITH {H_SQL}, r AS (SELECT symbol, CASE WHEN count(*) OVER {rows(14)} >= 14 THEN max(high) OVER {rows(14)} - min(low) OVER {rows(14)} END AS a FROM h),
    s AS (SELECT symbol, avg(a) AS atr_mean, stddev_samp(a) AS atr_std, min(a) AS atr_min, max(a) AS atr_max, quantile_cont(a, 0.5) AS atr_median,
    avg(a) * 0.2::DOUBLE * 0.311035::DOUBLE - 0.8::DOUBLE AS net_tp, -(avg(a) * 0.1::DOUBLE * 0.311035::DOUBLE + 0.8::DOUBLE) AS net_sl FROM r GROUP BY 1)
    SELECT *, CASE WHEN net_tp > 0 THEN abs(net_sl) / (net_tp + abs(net_sl)) END AS break_even_win_rate,
    0.8::DOUBLE / (atr_mean * 0.2::DOUBLE * 31.1035::DOUBLE) AS min_size, 0.8::DOUBLE / (atr_mean * 0.311035::DOUBLE) AS min_tp_multiplier,
    CASE WHEN net_tp > 0 THEN 0.4::DOUBLE * net_tp + 0.6::DOUBLE * net_sl END AS expected_pnl FROM s""",
    _BE,
)(lambda spark, d: A.break_even(hourly(spark, d), win_rate=0.4))
