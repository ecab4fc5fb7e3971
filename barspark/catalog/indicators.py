"""Indicator and feature-set queries on hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.catalog.base import D_SQL, H_SQL, O, hourly, order_days, query, rows, table
from barspark.functions import indicators as I
from barspark.functions.calendar import cyclic
from barspark.functions.study import Study
from barspark.operators import features as FT

E = "1e-9::DOUBLE"


def _pick(df, *cols):
    return df.select("symbol", "ts", *cols)


def _h(select: str, steps: str = "") -> str:
    return f"WITH {H_SQL}{', ' + steps if steps else ''} {select}"


# -- moving means ----------------------------------------------------------------------------------


@query(
    "sma_dist",
    f"""WITH {D_SQL}, a AS (SELECT *, avg(close) OVER {rows(20)} AS m20, avg(close) OVER {rows(200)} AS m200,
    lag(close) OVER {O} AS pc FROM d),
    t AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM a),
    r AS (SELECT *, avg(tr) OVER {rows(14)} AS atr FROM t)
    SELECT symbol, ts, (close - m20) / (atr + {E}) AS dist_20, (close - m200) / (atr + {E}) AS dist_200 FROM r""",
    "dist_20 dist_200",
)
def _sma_dist(spark, d):
    s = Study()
    s.out("dist_20", s.dist_sma_atr("close", 20))
    s.out("dist_200", s.dist_sma_atr("close", 200))
    return _pick(s.apply(order_days(spark, d)), "dist_20", "dist_200")


@query(
    "sma_long",
    f"WITH {D_SQL} SELECT symbol, ts, avg(close) OVER {rows(500)} AS sma_500 FROM d",
    "sma_500",
    4,
)
def _sma_long(spark, d):
    return _pick(I.sma(order_days(spark, d), "close", 500, out="sma_500"), "sma_500")


def _ema_sql(span: int, col: str = "close", src: str = "h") -> str:
    a = 2 / (span + 1)
    return f"""list_reduce(list({col}) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING),
      lambda acc, x: acc * {1 - a!r}::DOUBLE + x * {a!r}::DOUBLE)"""


for _name, _rows in (("ema", None), ("ema_chunked", 90)):
    query(
        _name,
        _h(f"SELECT symbol, ts, {_ema_sql(12)} AS ema_12, {_ema_sql(26)} AS ema_26 FROM h"),
        "ema_12 ema_26",
    )(
        lambda spark, d, r=_rows: _pick(
            I.ema(I.ema(hourly(spark, d), "close", 12, out="ema_12", chunk_rows=r), "close", 26, out="ema_26", chunk_rows=r),
            "ema_12",
            "ema_26",
        )
    )

query(
    "macd",
    _h(
        f"SELECT symbol, ts, line, {_ema_sql(9, 'line')} AS signal, line - {_ema_sql(9, 'line')} AS hist FROM l",
        f"l AS (SELECT symbol, ts, {_ema_sql(12)} - {_ema_sql(26)} AS line FROM h)",
    ),
    "line signal hist",
)(lambda spark, d: _pick(I.macd(hourly(spark, d), "close", out=("line", "signal", "hist")), "line", "signal", "hist"))

# -- oscillators -----------------------------------------------------------------------------------

_GAIN = f"""g AS (SELECT *, close - lag(close) OVER {O} AS dc FROM h),
  u AS (SELECT *, CASE WHEN dc IS NOT NULL THEN greatest(dc, 0.0::DOUBLE) END AS up,
        CASE WHEN dc IS NOT NULL THEN greatest(-dc, 0.0::DOUBLE) END AS dn FROM g)"""
_RSI_SQL = _h(
    "SELECT symbol, ts, 100 - 100 / (1 + au / nullif(ad, 0)) AS rsi_14 FROM v",
    f"{_GAIN}, v AS (SELECT *, avg(up) OVER {rows(14)} AS au, avg(dn) OVER {rows(14)} AS ad FROM u)",
)
for _name, _rows in (("rsi", None), ("rsi_chunked", 60)):
    query(_name, _RSI_SQL, "rsi_14")(
        lambda spark, d, r=_rows: _pick(I.rsi(hourly(spark, d), "close", 14, out="rsi_14", chunk_rows=r), "rsi_14")
    )

query(
    "stochastic",
    _h(
        f"SELECT symbol, ts, k, avg(k) OVER {rows(3)} AS d FROM s",
        f"""s AS (SELECT symbol, ts, 100 * (close - min(low) OVER {rows(14)})
        / (max(high) OVER {rows(14)} - min(low) OVER {rows(14)} + {E}) AS k FROM h)""",
    ),
    "k d",
    5,
)(lambda spark, d: _pick(I.stochastic(hourly(spark, d), 14, 3, out=("k", "d")), "k", "d"))

query(
    "cci",
    _h(
        f"SELECT symbol, ts, (tp - m) / (0.015::DOUBLE * (avg(abs(tp - m)) OVER {rows(20)} + {E})) AS cci FROM b",
        f"""a AS (SELECT *, (high + low + close) / 3 AS tp FROM h), b AS (SELECT *, avg(tp) OVER {rows(20)} AS m FROM a)""",
    ),
    "cci",
    4,
)(lambda spark, d: _pick(I.cci(hourly(spark, d), 20, out="cci"), "cci"))

query(
    "williams_r",
    _h(
        f"""SELECT symbol, ts, -100 * (max(high) OVER {rows(14)} - close)
        / (max(high) OVER {rows(14)} - min(low) OVER {rows(14)} + {E}) AS willr FROM h"""
    ),
    "willr",
    5,
)(lambda spark, d: _pick(I.williams_r(hourly(spark, d), 14, out="willr"), "willr"))

_TR = f"""pc AS (SELECT *, lag(close) OVER {O} AS pc, lag(high) OVER {O} AS ph, lag(low) OVER {O} AS pl FROM h),
  tr AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM pc)"""
for _name, _rows in (("atr", None), ("atr_chunked", 60)):
    query(
        _name,
        _h(
            f"SELECT symbol, ts, tr, atr, atr / avg(atr) OVER {rows(14)} AS atr_norm FROM a",
            f"{_TR}, a AS (SELECT *, avg(tr) OVER {rows(14)} AS atr FROM tr)",
        ),
        "tr atr atr_norm",
    )(
        lambda spark, d, r=_rows: _pick(
            I.atr_norm(
                I.atr(I.true_range(hourly(spark, d), out="tr", chunk_rows=r), 14, out="atr", chunk_rows=r),
                14,
                out="atr_norm",
                chunk_rows=r,
            ),
            "tr",
            "atr",
            "atr_norm",
        )
    )

_ADX = f"""{_TR}, dm AS (SELECT *, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
  CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm FROM tr),
  di AS (SELECT *, 100 * (avg(pdm) OVER {rows(14)} / (avg(tr) OVER {rows(14)} + {E})) AS pdi,
         100 * (avg(mdm) OVER {rows(14)} / (avg(tr) OVER {rows(14)} + {E})) AS mdi FROM dm),
  dx AS (SELECT *, 100 * abs(pdi - mdi) / (pdi + mdi + {E}) AS dx FROM di),
  ax AS (SELECT *, avg(dx) OVER {rows(14)} AS adx FROM dx)"""
query("adx", _h("SELECT symbol, ts, adx, pdi, mdi FROM ax", _ADX), "adx pdi mdi")(
    lambda spark, d: _pick(I.adx(hourly(spark, d), 14, out=("adx", "pdi", "mdi")), "adx", "pdi", "mdi")
)

_BB = f"""bb AS (SELECT *, avg(close) OVER {rows(20)} AS mid, stddev_samp(close) OVER {rows(20)} AS sd FROM h)"""
query(
    "bollinger",
    _h("SELECT symbol, ts, mid + 2 * sd AS upper, mid, mid - 2 * sd AS lower FROM bb", _BB),
    "upper mid lower",
)(lambda spark, d: _pick(I.bollinger(hourly(spark, d), "close", 20, out=("upper", "mid", "lower")), "upper", "mid", "lower"))
query(
    "bollinger_pos",
    _h(f"SELECT symbol, ts, (close - (mid - 2 * sd)) / (4 * sd + {E}) AS pos FROM bb", _BB),
    "pos",
)(lambda spark, d: _pick(I.bb_position(hourly(spark, d), "close", 20, out="pos"), "pos"))

# -- flow ------------------------------------------------------------------------------------------

_FLOW = f"""fl AS (SELECT *, coalesce(sign(close - lag(close) OVER {O}), 0) * volume AS ob,
  (close - open) / (high - low + {E}) * volume AS cv FROM h),
  cum AS (SELECT *, sum(ob) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv,
  sum(cv) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cvd FROM fl)"""
for _name, _rows in (("obv", None), ("obv_chunked", 60)):
    query(_name, _h("SELECT symbol, ts, obv FROM cum", _FLOW), "obv")(
        lambda spark, d, r=_rows: _pick(I.obv(hourly(spark, d), chunk_rows=r), "obv")
    )
query("cvd", _h("SELECT symbol, ts, cvd FROM cum", _FLOW), "cvd")(lambda spark, d: _pick(I.cvd(hourly(spark, d)), "cvd"))
for _flow, _fn in (("cvd", I.cvd_z), ("obv", I.obv_z)):
    for _tag, _rows in (("", None), ("_chunked", 80)):
        query(
            f"{_flow}_z{_tag}",
            _h(
                f"""SELECT symbol, ts, ({_flow} - avg({_flow}) OVER {rows(50)})
                / (stddev_samp({_flow}) OVER {rows(50)} + {E}) AS z FROM cum""",
                _FLOW,
            ),
            "z",
        )(lambda spark, d, fn=_fn, r=_rows: _pick(fn(hourly(spark, d), 50, out="z", chunk_rows=r), "z"))

query("roc", _h(f"SELECT symbol, ts, close / lag(close, 5) OVER {O} - 1 AS roc_5 FROM h"), "roc_5")(
    lambda spark, d: _pick(I.roc(hourly(spark, d), "close", 5, out="roc_5"), "roc_5")
)

query(
    "volatility",
    _h(
        f"SELECT symbol, ts, r AS log_ret, stddev_samp(r) OVER {rows(20)} AS vol_20 FROM r",
        f"r AS (SELECT *, ln(close) - ln(lag(close) OVER {O}) AS r FROM h)",
    ),
    "log_ret vol_20",
)(
    lambda spark, d: _pick(
        I.volatility(I.log_return(hourly(spark, d), "close", 1, out="log_ret"), "log_ret", 20, out="vol_20"), "log_ret", "vol_20"
    )
)

query(
    "mfi",
    _h(
        f"SELECT symbol, ts, 100 - 100 / (1 + sum(pf) OVER {rows(14)} / (sum(nf) OVER {rows(14)} + {E})) AS mfi FROM f",
        f"""t AS (SELECT *, (high + low + close) / 3 AS tp FROM h), q AS (SELECT *, lag(tp) OVER {O} AS ptp FROM t),
        f AS (SELECT *, CASE WHEN tp > ptp THEN tp * volume ELSE 0 END AS pf,
        CASE WHEN tp < ptp THEN tp * volume ELSE 0 END AS nf FROM q)""",
    ),
    "mfi",
)(lambda spark, d: _pick(I.mfi(hourly(spark, d), 14, out="mfi"), "mfi"))

query(
    "volume_norm",
    _h(
        f"""SELECT symbol, ts, CASE WHEN count(volume) OVER {rows(20)} >= 20
        THEN volume / (avg(volume) OVER {rows(20)} + {E}) END AS vn FROM h"""
    ),
    "vn",
)(lambda spark, d: _pick(I.volume_norm(hourly(spark, d), "volume", 20, out="vn"), "vn"))

query(
    "pv_divergence",
    _h(
        f"""SELECT symbol, ts, f AS flag, (sum(f) OVER {rows(3)} = 3)::INTEGER AS strong FROM v""",
        f"""v AS (SELECT *, coalesce(((close - lag(close) OVER {O}) * (volume - lag(volume) OVER {O}) < 0)::INTEGER, 0)
        AS f FROM h)""",
    ),
)(lambda spark, d: _pick(I.price_volume_divergence(hourly(spark, d), out=("flag", "strong")), "flag", "strong"))

_NH = f"""nh AS (SELECT *, close = max(close) OVER {rows(20)} AS nh FROM h),
  pv AS (SELECT *, last_value(CASE WHEN nh THEN volume END IGNORE NULLS)
  OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hv FROM nh)"""
for _name, _rows in (("new_high_divergence", None), ("new_high_divergence_chunked", 60)):
    query(
        _name,
        _h("SELECT symbol, ts, coalesce((nh AND volume < hv)::INTEGER, 0) AS flag FROM pv", _NH),
    )(
        lambda spark, d, r=_rows: _pick(I.new_high_volume_divergence(hourly(spark, d), 20, out="flag", chunk_rows=r), "flag")
    )

query(
    "range_atr",
    _h(
        f"""SELECT symbol, ts, CASE WHEN count(*) OVER {rows(14)} >= 14
        THEN max(high) OVER {rows(14)} - min(low) OVER {rows(14)} END AS range_atr FROM h"""
    ),
    "range_atr",
)(lambda spark, d: _pick(I.range_atr(hourly(spark, d), 14), "range_atr"))

query(
    "rolling_zscore",
    _h(
        f"""SELECT symbol, ts, (volume - avg(volume) OVER {rows(30)})
        / (stddev_samp(volume) OVER {rows(30)} + {E}) AS z FROM h"""
    ),
    "z",
)(lambda spark, d: _pick(I.rolling_zscore(hourly(spark, d), "volume", 30, out="z"), "z"))

# -- time ------------------------------------------------------------------------------------------


@query(
    "time_cyclic",
    """SELECT event_id, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
    sin(2 * pi() * minute(ts) / 60) AS minute_sin, cos(2 * pi() * minute(ts) / 60) AS minute_cos,
    sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS tod_sin,
    cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS tod_cos FROM events""",
    "hour_sin hour_cos minute_sin minute_cos tod_sin tod_cos",
)
def _cyclic(spark, d):
    hour, minute = F.hour("ts"), F.minute("ts")
    hs, hc = cyclic(hour, 24)
    ms, mc = cyclic(minute, 60)
    ds, dc = cyclic(hour * 60 + minute, 1440)
    return table(spark, d, "events").select(
        "event_id",
        hs.alias("hour_sin"),
        hc.alias("hour_cos"),
        ms.alias("minute_sin"),
        mc.alias("minute_cos"),
        ds.alias("tod_sin"),
        dc.alias("tod_cos"),
    )


_DAY_SQL = _h(
    f"""SELECT symbol, ts, (close - day_open) / (day_open + {E}) AS dist_daily_open,
    coalesce((close - london) / (london + {E}), 0) AS dist_london_open,
    coalesce((close - ph) / (ph + {E}), 0) AS dist_prev_high, coalesce((close - pl) / (pl + {E}), 0) AS dist_prev_low,
    coalesce((close - pcl) / (pcl + {E}), 0) AS dist_prev_close, (close - dh) / (dh + {E}) AS dist_day_high,
    (close - dl) / (dl + {E}) AS dist_day_low, (close - m200) / (m200 + {E}) AS dist_sma_200,
    (close - m1440) / (m1440 + {E}) AS dist_sma_1440, coalesce((close - c60) / (c60 + {E}), 0) AS roc_60,
    coalesce(s60 / (s200 + {E}), 0) AS vol_ratio_60_200 FROM y""",
    f"""r AS (SELECT *, ts::DATE AS day, ln(close) - ln(lag(close) OVER {O}) AS lr FROM h),
    dd AS (SELECT symbol, day, max(high) AS ph, min(low) AS pl, arg_max(close, ts) AS pcl FROM r GROUP BY 1, 2),
    x AS (SELECT r.*, dd.ph, dd.pl, dd.pcl FROM r LEFT JOIN dd ON r.symbol = dd.symbol AND r.day = dd.day + 1),
    y AS (SELECT *, first_value(open) OVER w AS day_open,
    last_value(CASE WHEN hour(ts) = 8 AND minute(ts) = 0 THEN open END IGNORE NULLS) OVER w AS london,
    max(high) OVER w AS dh, min(low) OVER w AS dl, avg(close) OVER {rows(200)} AS m200, avg(close) OVER {rows(1440)} AS m1440,
    lag(close, 60) OVER {O} AS c60, stddev_samp(lr) OVER {rows(60)} AS s60, stddev_samp(lr) OVER {rows(200)} AS s200
    FROM x WINDOW w AS (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING))""",
)
_DAY = (
    "dist_daily_open dist_london_open dist_prev_high dist_prev_low dist_prev_close dist_day_high dist_day_low dist_sma_200 "
    "dist_sma_1440 roc_60 vol_ratio_60_200"
)
for _name, _rows in (("day_features", None), ("day_features_chunked", 150)):
    query(_name, _DAY_SQL, _DAY, 5)(
        lambda spark, d, r=_rows: _pick(FT.day_features(hourly(spark, d), chunk_rows=r), *_DAY.split())
    )

# -- feature sets ----------------------------------------------------------------------------------


def _full(agg: str, col: str, n: int) -> str:
    return f"CASE WHEN count({col}) OVER {rows(n)} >= {n} THEN {agg}({col}) OVER {rows(n)} END"


_MIN_COLS = "ret_1 ret_5 ret_15 vol_20 vol_60 range_n mom_10 mom_30 ema_spread_n rsi_14 tod_sin tod_cos"


@query(
    "features_minimal",
    _h(
        f"""SELECT symbol, ts, lr AS ret_1, r5 AS ret_5, r15 AS ret_15, v20 AS vol_20, v60 AS vol_60,
        (high - low) / close AS range_n, m10 AS mom_10, m30 AS mom_30, (e12 - e26) / close AS ema_spread_n,
        100 - 100 / (1 + au / nullif(ad, 0)) AS rsi_14, sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS tod_sin,
        cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS tod_cos FROM w
        WHERE v60 IS NOT NULL AND r15 IS NOT NULL AND 100 - 100 / (1 + au / nullif(ad, 0)) IS NOT NULL""",
        f"""{_GAIN}, l AS (SELECT *, ln(close) - ln(lag(close) OVER {O}) AS lr, ln(close) - ln(lag(close, 5) OVER {O}) AS r5,
        ln(close) - ln(lag(close, 15) OVER {O}) AS r15, {_ema_sql(12)} AS e12, {_ema_sql(26)} AS e26 FROM u),
        w AS (SELECT *, {_full("stddev_samp", "lr", 20)} AS v20, {_full("stddev_samp", "lr", 60)} AS v60,
        {_full("avg", "lr", 10)} AS m10, {_full("avg", "lr", 30)} AS m30, {_full("avg", "up", 14)} AS au,
        {_full("avg", "dn", 14)} AS ad FROM l)""",
    ),
    _MIN_COLS,
    5,
)
def _minimal(spark, d):
    return FT.minimal_features(hourly(spark, d))


_CTX_COLS = "atr_m5_n rsi_m5 dist_sma_20_m5 macd_n_m5 bb_pos_m5 atr_m5"
_CTX_SQL = f"""WITH {H_SQL}, c AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_min(open, ts) AS open,
  max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM h GROUP BY 1, 2),
  g AS (SELECT *, lag(close) OVER {O} AS pc FROM c),
  u AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0.0::DOUBLE) END AS up,
    CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0.0::DOUBLE) END AS dn,
    {_ema_sql(12)} - {_ema_sql(26)} AS line FROM g),
  v AS (SELECT *, {_full("avg", "tr", 14)} AS atr, {_full("avg", "up", 14)} AS au, {_full("avg", "dn", 14)} AS ad,
    {_full("avg", "close", 20)} AS mid, {_full("stddev_samp", "close", 20)} AS sd FROM u),
  k AS (SELECT symbol, ts + INTERVAL 4 HOUR AS seen, atr, 100 - 100 / (1 + au / (ad + {E})) AS rsi,
    (close - mid) / (mid + {E}) AS dist, line / (close + {E}) AS macd, (close - (mid - 2 * sd)) / (4 * sd + {E}) AS bb FROM v)
  SELECT h.symbol, h.ts, coalesce(atr, 0) / (close + {E}) AS atr_m5_n, coalesce(rsi, 50) AS rsi_m5,
    coalesce(dist, 0) AS dist_sma_20_m5, coalesce(macd, 0) AS macd_n_m5, coalesce(bb, 0.5) AS bb_pos_m5,
    coalesce(atr, 0) AS atr_m5 FROM h ASOF LEFT JOIN k ON h.symbol = k.symbol AND h.ts + INTERVAL 1 HOUR >= k.seen"""


@query("features_context", _CTX_SQL, _CTX_COLS, 5)
def _context(spark, d):
    out = FT.m5_context(hourly(spark, d), width="4 hours", fine_width="1 hour")
    return _pick(out, *_CTX_COLS.split())


# The 36-column set, hourly bars with four-hour and daily context.


def _wide_sql(align: str) -> str:
    def study(src: str, tag: str) -> str:
        """Indicator columns of one bar width, prefixed steps per width."""
        return f"""{tag}1 AS (SELECT *, lag(close) OVER {O} AS pc, lag(high) OVER {O} AS ph, lag(low) OVER {O} AS pl,
          lag(volume) OVER {O} AS pv, lag(volume, 5) OVER {O} AS pv5, {_ema_sql(12)} - {_ema_sql(26)} AS line,
          close = max(close) OVER {rows(20)} AS nh FROM {src}),
        {tag}2 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
          CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0.0::DOUBLE) END AS up,
          CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0.0::DOUBLE) END AS dn,
          CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
          CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm,
          coalesce(((close - pc) * (volume - pv) < 0)::INTEGER, 0) AS dv,
          coalesce(sign(close - pc), 0) * volume AS ob, (close - open) / (high - low + {E}) * volume AS cv,
          line - {_ema_sql(9, "line")} AS hist,
          last_value(CASE WHEN nh THEN volume END IGNORE NULLS)
            OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hv,
          100 * (close - min(low) OVER {rows(14)}) / (max(high) OVER {rows(14)} - min(low) OVER {rows(14)} + {E}) AS k
          FROM {tag}1),
        {tag}3 AS (SELECT *, avg(tr) OVER {rows(14)} AS atr, avg(up) OVER {rows(14)} AS au, avg(dn) OVER {rows(14)} AS ad,
          100 * (avg(pdm) OVER {rows(14)} / (avg(tr) OVER {rows(14)} + {E})) AS pdi,
          100 * (avg(mdm) OVER {rows(14)} / (avg(tr) OVER {rows(14)} + {E})) AS mdi,
          avg(close) OVER {rows(20)} AS m20, stddev_samp(close) OVER {rows(20)} AS s20, avg(close) OVER {rows(200)} AS m200,
          CASE WHEN count(*) OVER {rows(20)} >= 20 THEN volume / (avg(volume) OVER {rows(20)} + {E}) END AS vn,
          sum(ob) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv,
          sum(cv) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cvd,
          avg(k) OVER {rows(3)} AS kd, sum(dv) OVER {rows(3)} AS dv3 FROM {tag}2),
        {tag} AS (SELECT *, 100 - 100 / (1 + au / nullif(ad, 0)) AS rsi,
          (close - (m20 - 2 * s20)) / (4 * s20 + {E}) AS bb, (close - m20) / (atr + {E}) AS d20,
          (close - m200) / (atr + {E}) AS d200, atr / nullif(avg(atr) OVER {rows(14)}, 0) AS an,
          avg(100 * abs(pdi - mdi) / (pdi + mdi + {E})) OVER {rows(14)} AS adx,
          (obv - avg(obv) OVER {rows(50)}) / (stddev_samp(obv) OVER {rows(50)} + {E}) AS obz,
          (cvd - avg(cvd) OVER {rows(50)}) / (stddev_samp(cvd) OVER {rows(50)} + {E}) AS cvz FROM {tag}3)"""

    def roll(width: str, name: str) -> str:
        return f"""{name} AS (SELECT symbol, time_bucket(INTERVAL '{width}', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high,
          min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM h GROUP BY 1, 2)"""

    seen = "ts" if align == "open" else "ts + INTERVAL 4 HOUR"
    seen_day = "ts" if align == "open" else "ts + INTERVAL 1 DAY"
    at = "a.ts" if align == "open" else "a.ts + INTERVAL 1 HOUR"
    return f"""WITH {H_SQL}, {roll("4 hours", "hm")}, {roll("1 day", "hs")}, {study("h", "f")}, {study("hm", "m")},
    {study("hs", "s")},
    fm AS (SELECT symbol, {seen} AS seen, rsi, bb, d20, d200, m200, atr, an, vn, cvz, obz FROM m),
    fs AS (SELECT symbol, {seen_day} AS seen, rsi, bb, cvz, obz FROM s),
    a AS (SELECT *, lead(atr) OVER {O} AS natr, lead(an) OVER {O} AS nan_ FROM f),
    z AS (SELECT a.symbol, a.ts, a.rsi AS rsi_f, a.bb AS bb_f, a.d20 AS d20_f, a.d200 AS d200_f, a.k, a.kd, a.hist, a.atr AS atr_f,
      natr, a.an AS an_f, nan_, a.adx AS adx_f, a.vn AS vn_f, a.close / a.pc - 1 AS ret, a.volume / nullif(a.pv5, 0) - 1 AS vr,
      a.pv5, a.dv, a.dv3, a.nh, a.volume, a.hv, a.cvz AS cvz_f, a.obz AS obz_f, fm.rsi AS rsi_m, fm.bb AS bb_m, fm.d20 AS d20_m,
      fm.d200 AS d200_m, fm.m200 AS m200_m, fm.atr AS atr_m, fm.an AS an_m, fm.vn AS vn_m, fm.cvz AS cvz_m, fm.obz AS obz_m,
      fs.rsi AS rsi_s, fs.bb AS bb_s, fs.cvz AS cvz_s, fs.obz AS obz_s
      FROM a ASOF LEFT JOIN fm ON a.symbol = fm.symbol AND {at} >= fm.seen
      ASOF LEFT JOIN fs ON a.symbol = fs.symbol AND {at} >= fs.seen),
    o AS (SELECT symbol, ts, coalesce(rsi_f, 50) AS rsi_m5, coalesce(bb_f, 0.5) AS bb_pos_m5, coalesce(d20_f, 0) AS dist_sma_20_m5,
      coalesce(k, 50) AS stoch_k_m5, coalesce(kd, 50) AS stoch_d_m5, coalesce(hist / (atr_f + {E}), 0) AS macd_hist_m5,
      coalesce(an_f, nan_, 1) AS atr_norm_m5, coalesce(atr_f, natr, 0) AS atr_m5, coalesce(an_m, 1) AS atr_norm_m5_smooth,
      coalesce(atr_m, 0) AS atr_m5_smooth, coalesce(adx_f, 20) AS adx, m200_m AS sma_200, coalesce(cvz_f, 0) AS cvd_m5,
      coalesce(d200_f, 0) AS dist_sma_200_m5, coalesce(d200_m, 0) AS dist_sma_200, coalesce(ret, 0) AS ret_1_m5,
      coalesce(obz_f, 0) AS obv_m5, coalesce(vn_f, 1) AS volume_m5_norm, coalesce(rsi_m, 50) AS rsi_m15,
      coalesce(bb_m, 0.5) AS bb_pos_m15, coalesce(d20_m, 0) AS dist_sma_20_m15, coalesce(cvz_m, 0) AS cvd_m15, obz_m AS obv_m15,
      coalesce(vn_m, 1) AS volume_m15_norm, coalesce(rsi_s, 50) AS rsi_m60, coalesce(bb_s, 0.5) AS bb_pos_m60,
      coalesce(cvz_s, 0) AS cvd_m60, coalesce(obz_s, 0) AS obv_m60,
      CASE WHEN pv5 IS NULL THEN 0 ELSE vr END AS volume_roc, dv AS divergence_volume_m5,
      (dv3 = 3)::INTEGER AS divergence_volume_m5_strong,
      coalesce((nh AND volume < hv)::INTEGER, 0) AS divergence_volume_new_high_m5 FROM z)
    SELECT * FROM o WHERE obv_m15 IS NOT NULL AND sma_200 IS NOT NULL"""


_WIDE_INT = ("divergence_volume_m5", "divergence_volume_m5_strong", "divergence_volume_new_high_m5")
_WIDE = [
    c
    for c in FT.M5_COLUMNS
    if c not in (*_WIDE_INT, "mfi_m5", "mfi_m15", "mfi_m60", "atr_norm_m5_native", "atr_m5_native", "dist_sma_200_m15")
]


def _wide(spark, d, align: str, chunk_rows=None):
    flags = FT.FeatureFlags(m60_context=True)
    out = FT.m5_features(
        hourly(spark, d), fine="1 hour", mid="4 hours", slow="1 day", align=align, flags=flags, rolled=True, chunk_rows=chunk_rows
    )
    return _pick(out, *_WIDE, *_WIDE_INT)


for _align in ("open", "close"):
    query(f"features_wide_{_align}", _wide_sql(_align), " ".join(_WIDE), 4)(lambda spark, d, a=_align: _wide(spark, d, a))
query("features_wide_chunked", _wide_sql("close"), " ".join(_WIDE), 4)(lambda spark, d: _wide(spark, d, "close", 150))


_FLAT = ("rsi_m5", "adx", "obv_m5", "volume_m15_norm", "cvd_m60")


@query(
    "features_switched_off",
    _h("SELECT symbol, 50.0::DOUBLE AS rsi_m5, 20.0::DOUBLE AS adx, 0.0::DOUBLE AS obv_m5, 1.0::DOUBLE AS volume_m15_norm, 0.0::DOUBLE AS cvd_m60, count(*) AS n FROM h GROUP BY symbol"),
    " ".join(_FLAT),
)
def _off(spark, d):
    flags = FT.FeatureFlags(rsi=False, adx=False, obv=False, volume_m15=False, cvd=False)
    out = FT.m5_features(hourly(spark, d), fine="1 hour", mid="4 hours", slow="1 day", align="open", flags=flags, rolled=True)
    return out.groupBy("symbol", *_FLAT).agg(F.count(F.lit(1)).alias("n"))


_M1 = "rsi_m5 bb_pos_m5 dist_sma_20_m5 stoch_k_m5 macd_hist_m5 rsi_m15 bb_pos_m15 dist_sma_20_m15 rsi_m60 bb_pos_m60 bb_position dist_sma_20 rsi_14 ret_1 atr_14 volume_roc".split()


def _m1_sql() -> str:
    def study(src: str, tag: str) -> str:
        return f"""{tag}1 AS (SELECT *, lag(close) OVER {O} AS pc, lag(volume, 5) OVER {O} AS pv5,
          {_ema_sql(12)} - {_ema_sql(26)} AS line,
          100 * (close - min(low) OVER {rows(14)}) / (max(high) OVER {rows(14)} - min(low) OVER {rows(14)} + {E}) AS k FROM {src}),
        {tag}2 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
          CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0.0::DOUBLE) END AS up,
          CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0.0::DOUBLE) END AS dn,
          line - {_ema_sql(9, "line")} AS hist FROM {tag}1),
        {tag} AS (SELECT *, avg(tr) OVER {rows(14)} AS atr, avg(close) OVER {rows(20)} AS m20,
          (close - (avg(close) OVER {rows(20)} - 2 * stddev_samp(close) OVER {rows(20)}))
            / (4 * stddev_samp(close) OVER {rows(20)} + {E}) AS bb,
          100 - 100 / (1 + avg(up) OVER {rows(14)} / nullif(avg(dn) OVER {rows(14)}, 0)) AS rsi FROM {tag}2)"""

    def roll(width: str, name: str) -> str:
        return f"""{name} AS (SELECT symbol, time_bucket(INTERVAL '{width}', ts) AS ts, max(high) AS high, min(low) AS low,
          arg_max(close, ts) AS close, sum(volume) AS volume FROM h GROUP BY 1, 2)"""

    def ffill(c: str) -> str:
        return f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS {c}"

    return f"""WITH {H_SQL}, {roll("4 hours", "b4")}, {roll("8 hours", "b8")}, {roll("1 day", "b24")}, {study("h", "f")},
    {study("b4", "x")}, {study("b8", "y")}, {study("b24", "z")},
    j AS (SELECT f.symbol, f.ts, coalesce(x.rsi, 50) AS rsi_m5, coalesce(x.bb, 0.5) AS bb_pos_m5,
      coalesce((x.close - x.m20) / (x.atr + {E}), 0) AS dist_sma_20_m5, coalesce(x.k, 50) AS stoch_k_m5,
      coalesce(x.hist / (x.atr + {E}), 0) AS macd_hist_m5, coalesce(y.rsi, 50) AS rsi_m15, coalesce(y.bb, 0.5) AS bb_pos_m15,
      coalesce((y.close - y.m20) / (y.atr + {E}), 0) AS dist_sma_20_m15, coalesce(z.rsi, 50) AS rsi_m60,
      coalesce(z.bb, 0.5) AS bb_pos_m60, f.bb AS bb_position, (f.close - f.m20) / (f.atr + {E}) AS dist_sma_20, f.rsi AS rsi_14,
      coalesce(f.close / f.pc - 1, 0) AS ret_1, f.atr AS atr_14, coalesce(f.volume / f.pv5 - 1, 0) AS volume_roc FROM f
      ASOF LEFT JOIN (SELECT *, ts + INTERVAL 4 HOUR AS seen FROM x) x ON f.symbol = x.symbol AND f.ts + INTERVAL 1 HOUR >= x.seen
      ASOF LEFT JOIN (SELECT *, ts + INTERVAL 8 HOUR AS seen FROM y) y ON f.symbol = y.symbol AND f.ts + INTERVAL 1 HOUR >= y.seen
      ASOF LEFT JOIN (SELECT *, ts + INTERVAL 1 DAY AS seen FROM z) z ON f.symbol = z.symbol AND f.ts + INTERVAL 1 HOUR >= z.seen)
    SELECT symbol, ts, {", ".join(ffill(c) for c in _M1)} FROM j"""


for _name, _rows in (("features_m1", None), ("features_m1_chunked", 200)):
    query(_name, _m1_sql(), " ".join(_M1), 4)(
        lambda spark, d, r=_rows: FT.m1_features(
            hourly(spark, d), widths=("4 hours", "8 hours", "1 day"), fine_width="1 hour", chunk_rows=r
        )
    )


def _m1_fine_sql() -> str:
    def repeated(width: str, tag: str) -> str:
        return f"""{tag}0 AS (SELECT h.symbol, h.ts, b.high, b.low, b.close FROM h JOIN (SELECT symbol,
          time_bucket(INTERVAL '{width}', ts) AS b, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close
          FROM h GROUP BY 1, 2) b ON h.symbol = b.symbol AND time_bucket(INTERVAL '{width}', h.ts) = b.b),
        {tag}1 AS (SELECT *, lag(close) OVER {O} AS pc FROM {tag}0),
        {tag} AS (SELECT symbol, ts, 100 - 100 / (1 + avg(CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0.0::DOUBLE) END)
          OVER {rows(14)} / nullif(avg(CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0.0::DOUBLE) END) OVER {rows(14)}, 0)) AS rsi,
          100 * (close - min(low) OVER {rows(14)}) / (max(high) OVER {rows(14)} - min(low) OVER {rows(14)} + {E}) AS k FROM {tag}1)"""

    return f"""WITH {H_SQL}, {repeated("4 hours", "x")}, {repeated("8 hours", "y")}, {repeated("1 day", "z")}
    SELECT x.symbol, x.ts, coalesce(x.rsi, 50) AS rsi_m5, coalesce(x.k, 50) AS stoch_k_m5, coalesce(y.rsi, 50) AS rsi_m15,
    coalesce(z.rsi, 50) AS rsi_m60 FROM x JOIN y USING (symbol, ts) JOIN z USING (symbol, ts)"""


@query("features_m1_fine_grid", _m1_fine_sql(), "rsi_m5 stoch_k_m5 rsi_m15 rsi_m60", 4)
def _m1_fine(spark, d):
    out = FT.m1_features(hourly(spark, d), widths=("4 hours", "8 hours", "1 day"), fine_width="1 hour", indicator_grid="fine")
    return _pick(out, "rsi_m5", "stoch_k_m5", "rsi_m15", "rsi_m60")
