"""Queries on bars, quality, calendars and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.catalog.base import D_SQL, H_SQL, O, P_SQL, hourly, order_days, predictions, query, table, ticks
from barspark.functions.calendar import closes_bucket, in_session, on_days
from barspark.operators import bars as B
from barspark.operators import quality as Q

PRICES = "open high low close volume"


def _rollup_sql(width: str) -> str:
    return f"""SELECT event_type AS symbol, time_bucket(INTERVAL '{width}', ts) AS ts, arg_min(value, ts) AS open,
      max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume
      FROM events GROUP BY 1, 2"""


for _name, _width in (("ohlcv_5m", "5 minutes"), ("ohlcv_1h", "1 hour"), ("ohlcv_4h", "4 hours"), ("ohlcv_1d", "1 day")):
    query(_name, _rollup_sql(_width), PRICES)(
        lambda spark, d, w=_width: B.rollup_bars(ticks(spark, d), w, tie="tie")
    )

query("ohlcv_daily_orders", f"WITH {D_SQL} SELECT * FROM d", PRICES)(order_days)


@query(
    "rollup_of_rollup",
    f"""WITH {H_SQL} SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high,
    min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM h GROUP BY 1, 2""",
    PRICES,
)
def _rollup_of_rollup(spark, d):
    return B.rollup_bars(hourly(spark, d), "4 hours")


@query(
    "ohlcv_1h_range",
    """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events
    WHERE ts >= TIMESTAMP '2024-01-05 12:30:00' AND ts <= TIMESTAMP '2024-01-20 07:45:00' GROUP BY 1, 2""",
    PRICES,
)
def _range(spark, d):
    return B.rollup_bars(ticks(spark, d), "1 hour", tie="tie", start="2024-01-05 12:30:00", end="2024-01-20 07:45:00")


def _dup_days(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_totalprice").alias("close"),
        F.col("o_orderkey").alias("line"),
    )


for _keep, _fn in (("first", "arg_min"), ("last", "arg_max")):
    query(
        f"dedup_{_keep}",
        f"""SELECT o_orderpriority AS symbol, o_orderdate AS ts, {_fn}(o_totalprice, o_orderkey) AS close,
        {"min" if _keep == "first" else "max"}(o_orderkey) AS line FROM orders GROUP BY 1, 2""",
        "close",
    )(lambda spark, d, keep=_keep: Q.dedup_bars(_dup_days(spark, d), keep))


def _suspect(spark, d):
    """Line items as bars with rule breaks of every kind."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(F.col("l_extendedprice").cast("string")).alias("open"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax") - 0.02)).alias("high"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount") + 0.02)).alias("low"),
        (F.col("l_extendedprice") * (F.col("l_discount") - 0.005)).alias("close"),
        (F.col("l_quantity") - 2).alias("volume"),
    )


_SUSPECT_SQL = """SELECT l_returnflag AS symbol, l_shipdate AS ts,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS open,
  l_extendedprice * (1 + l_tax - 0.02::DOUBLE) AS high, l_extendedprice * (1 - l_discount + 0.02::DOUBLE) AS low,
  l_extendedprice * (l_discount - 0.005::DOUBLE) AS close, l_quantity - 2 AS volume FROM lineitem"""


@query(
    "validate_counts",
    f"""WITH b AS ({_SUSPECT_SQL}) SELECT count(*) AS n_rows, count(*) FILTER (open IS NULL) AS n_not_numeric,
    count(*) FILTER (open IS NOT NULL AND least(open, high, low, close) <= 0) AS n_nonpositive_price,
    count(*) FILTER (open IS NOT NULL AND volume < 0) AS n_negative_volume,
    count(*) FILTER (open IS NOT NULL AND high < low) AS n_high_below_low FROM b""",
)
def _validate(spark, d):
    return Q.validate_bars(_suspect(spark, d)).report


@query(
    "validate_clean",
    f"""WITH b AS ({_SUSPECT_SQL}) SELECT symbol, count(*) AS n, sum(close) AS close FROM b
    WHERE open IS NOT NULL AND least(open, high, low, close) > 0 AND volume >= 0 AND high >= low GROUP BY 1""",
    "close",
    2,
)
def _clean(spark, d):
    return Q.validate_bars(_suspect(spark, d)).clean.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("close").alias("close")
    )


@query(
    "validate_window",
    f"""WITH {H_SQL} SELECT count(*) AS n_rows, count(*) >= 260 AS size_ok, 0::BIGINT AS n_not_finite,
    count(*) FILTER (least(open, high, low, close) <= 0) AS n_nonpositive_price,
    count(*) FILTER (high < low) AS n_high_below_low,
    count(*) >= 260 AND count(*) FILTER (least(open, high, low, close) <= 0) = 0 AS ok FROM h""",
)
def _window_ok(spark, d):
    return Q.validate_window(hourly(spark, d), at_least=260)


@query(
    "validate_predictions",
    f"""WITH {P_SQL}, {H_SQL}, a AS (SELECT count(*) AS n_predictions,
    count(*) FILTER (probability < 0 OR probability > 1) AS n_bad_probability,
    count(*) FILTER (prediction NOT IN (0, 1)) AS n_bad_prediction FROM p),
    b AS (SELECT count(*) AS n_bars, count(*) FILTER (least(open, high, low, close) <= 0) AS n_bad_price FROM h)
    SELECT *, n_predictions > 0 AND n_bars > 0 AND n_bad_probability + n_bad_prediction + n_bad_price = 0 AS ok FROM a, b""",
)
def _pred_ok(spark, d):
    return Q.validate_predictions(predictions(spark, d), hourly(spark, d))


_PROFILE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "flat")
_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS n_null, 0::BIGINT AS n_inf, min({c}) AS min, max({c}) AS max,
    var_samp({c}) AS variance, coalesce(var_samp({c}) < 1e-10, true) AS zero_variance,
    coalesce(var_samp({c}) >= 1e-10 AND var_samp({c}) < 1e-3, false) AS low_variance FROM x"""
    for c in _PROFILE
)


@query("profile_cols", f"WITH x AS (SELECT *, 1.0::DOUBLE AS flat FROM lineitem) {_PROFILE_SQL}", "min max variance", 4)
def _profile(spark, d):
    return Q.profile(table(spark, d, "lineitem").withColumn("flat", F.lit(1.0)), _PROFILE)


@query(
    "label_by_month",
    """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS total,
    sum((o_orderstatus = 'F')::INTEGER)::BIGINT AS positive,
    100.0 * sum((o_orderstatus = 'F')::INTEGER) / count(*) AS positive_pct FROM orders GROUP BY 1""",
    "positive_pct",
)
def _by_month(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "F").cast("int").alias("label")
    )
    return Q.label_by_month(rows)


@query(
    "quality_issues",
    f"""WITH {P_SQL}, f AS (SELECT abs(corr(probability, label)) AS c, 100.0 * avg(label) AS pos FROM p),
    i AS (SELECT '1 features have zero variance' AS issue
    UNION ALL SELECT printf('strongest correlation is %.6f', c) FROM f WHERE c < 0.01
    UNION ALL SELECT printf('class imbalance: %.1f%% positive', pos) FROM f WHERE pos < 20 OR pos > 80)
    SELECT issue FROM i""",
)
def _issues(spark, d):
    p = predictions(spark, d).withColumn("flat", F.lit(1.0))
    return Q.quality_issues(Q.profile(p, ["probability", "flat"]), p, ["probability", "flat"])


@query(
    "class_balance",
    """WITH a AS (SELECT o_orderstatus AS split, count(*) FILTER (o_totalprice > 150000) AS n_pos,
    count(*) FILTER (o_totalprice <= 150000) AS n_neg, 100.0 * avg((o_totalprice > 150000)::INTEGER) AS pos_pct
    FROM orders GROUP BY 1), g AS (SELECT max(pos_pct) - min(pos_pct) AS max_gap FROM a)
    SELECT split, n_pos, n_neg, pos_pct, max_gap, max_gap <= 10 AS stable FROM a, g""",
    "pos_pct max_gap",
)
def _balance(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("split"), (F.col("o_totalprice") > 150000).cast("int").alias("label")
    )
    return Q.class_balance(rows)


@query(
    "extreme_moves",
    f"""WITH {H_SQL}, m AS (SELECT *, close / lag(close) OVER {O} - 1 AS mv FROM h)
    SELECT symbol, count(*) AS n_rows, count(*) FILTER (abs(mv) > 0.1) AS n_extreme,
    count(*) FILTER (least(open, high, low, close) <= 0) AS n_nonpositive_price,
    count(*) FILTER (volume < 0) AS n_negative_volume FROM m GROUP BY 1""",
)
def _moves(spark, d):
    return Q.extreme_moves(hourly(spark, d))


_GAPPY = """g AS (SELECT event_type AS symbol, ts, event_id,
  CASE WHEN value < 10 THEN NULL WHEN value > 200 THEN NULL ELSE value END AS x FROM events)"""


def _gappy(spark, d):
    inf = F.lit(float("inf"))
    return table(spark, d, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "event_id",
        F.when(F.col("value") < 10, None).when(F.col("value") > 200, inf).otherwise(F.col("value")).alias("x"),
    )


_FILLED = "last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
for _name, _rows in (("clean_features_zero", None), ("clean_features_zero_chunked", 300)):
    query(_name, f"WITH {_GAPPY} SELECT symbol, ts, event_id, coalesce({_FILLED}, 0.0) AS x FROM g", "x")(
        lambda spark, d, r=_rows: Q.clean_features(_gappy(spark, d), ["x"], "zero", chunk_rows=r)
    )


@query(
    "clean_features_drop",
    f"WITH {_GAPPY}, f AS (SELECT symbol, ts, event_id, {_FILLED} AS x FROM g) SELECT * FROM f WHERE x IS NOT NULL",
    "x",
)
def _clean_drop(spark, d):
    return Q.clean_features(_gappy(spark, d), ["x"], "drop")


# -- calendars -------------------------------------------------------------------------------------

for _session, _cond in (
    ("london", "hour(ts) >= 8 AND hour(ts) < 16"),
    ("ny", "hour(ts) >= 13 AND hour(ts) < 22"),
    ("asian", "hour(ts) >= 0 AND hour(ts) < 9"),
    ("london_ny", "hour(ts) >= 8 AND hour(ts) < 22"),
    ("custom", "hour(ts) >= 21 OR hour(ts) < 4"),
):
    query(f"session_{_session}", f"SELECT event_id, ts FROM events WHERE {_cond}")(
        lambda spark, d, s=_session: table(spark, d, "events")
        .where(in_session("ts", s, *((21, 4) if s == "custom" else (None, None))))
        .select("event_id", "ts")
    )


@query(
    "weekday_filter",
    "SELECT event_id FROM events WHERE isodow(ts) IN (1, 5) OR ts::DATE = DATE '2024-01-10'",
)
def _weekday(spark, d):
    return table(spark, d, "events").where(on_days("ts", ["Mon", "Fri", "2024-01-10"])).select("event_id")


@query("closes_bucket", "SELECT event_id FROM events WHERE (minute(ts) + 1) % 5 = 0")
def _closes(spark, d):
    return table(spark, d, "events").where(closes_bucket("ts", 5)).select("event_id")


@query("drop_date_prefix", "SELECT event_id FROM events WHERE NOT starts_with(strftime(ts, '%Y.%m.%d'), '2024.01.1')")
def _prefix(spark, d):
    rows = table(spark, d, "events").withColumn("Date", F.date_format("ts", "yyyy.MM.dd"))
    return B.drop_date_prefix(rows, "Date", "2024.01.1").select("event_id")


@query(
    "latest_days",
    f"""WITH {H_SQL}, m AS (SELECT symbol, max(ts) AS t FROM h GROUP BY 1)
    SELECT h.* FROM h JOIN m USING (symbol) WHERE ts >= t - INTERVAL 7 DAY""",
    PRICES,
)
def _latest_days(spark, d):
    return B.latest_bars(hourly(spark, d), days=7)


for _n in (25, 2000):
    query(
        f"latest_{_n}",
        f"WITH {H_SQL} SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= {_n}",
        PRICES,
    )(lambda spark, d, n=_n: B.latest_bars(hourly(spark, d), n=n))


# -- alignment -------------------------------------------------------------------------------------

_COARSE = """c AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS b, max(high) AS c_high, arg_max(close, ts) AS c_close
  FROM h GROUP BY 1, 2)"""


def _coarse(spark, d):
    return B.rollup_bars(hourly(spark, d), "4 hours").select(
        "symbol", "ts", F.col("high").alias("c_high"), F.col("close").alias("c_close")
    )


_OPEN_SQL = f"""WITH {H_SQL}, {_COARSE} SELECT h.symbol, h.ts, h.close, c.c_high, c.c_close FROM h
  ASOF JOIN c ON h.symbol = c.symbol AND h.ts >= c.b"""
_CLOSE_SQL = f"""WITH {H_SQL}, {_COARSE} SELECT h.symbol, h.ts, h.close, c.c_high, c.c_close FROM h
  ASOF LEFT JOIN (SELECT *, b + INTERVAL 4 HOUR AS seen FROM c) c
  ON h.symbol = c.symbol AND h.ts + INTERVAL 1 HOUR >= c.seen"""
for _mode, _sql in (("open", _OPEN_SQL), ("close", _CLOSE_SQL)):
    for _gaps in (False, True):
        query(f"asof_{_mode}" + ("_carried" if _gaps else ""), _sql, "close c_high c_close")(
            lambda spark, d, m=_mode, g=_gaps: B.asof_align(
                hourly(spark, d).select("symbol", "ts", "close"),
                _coarse(spark, d),
                ["c_high", "c_close"],
                "4 hours",
                mode=m,
                fine_width="1 hour",
                gaps=g,
                chunk_rows=200 if g else None,
            )
        )


@query(
    "asof_pick",
    f"""WITH {H_SQL} SELECT h.symbol, h.ts, e.ts AS tick_ts FROM h ASOF LEFT JOIN events e
    ON h.symbol = e.event_type AND h.ts >= e.ts""",
)
def _pick(spark, d):
    fine = ticks(spark, d).select("symbol", F.col("ts").alias("_t"), F.col("ts").alias("tick_ts"))
    return B.asof_last(hourly(spark, d).select("symbol", "ts"), fine, ["tick_ts"], right_time="_t")


_PREV = """WITH {h}, dd AS (SELECT symbol, ts::DATE AS day, max(high) AS prev_high, min(low) AS prev_low,
  arg_max(close, ts) AS prev_close FROM {n} GROUP BY 1, 2)"""


@query(
    "prev_day",
    _PREV.format(h=H_SQL, n="h")
    + """ SELECT h.symbol, h.ts, h.close, prev_high, prev_low, prev_close FROM h LEFT JOIN dd
    ON h.symbol = dd.symbol AND h.ts::DATE = dd.day + 1""",
    "close prev_high prev_low prev_close",
)
def _prev_day(spark, d):
    return B.prev_day(hourly(spark, d)).select("symbol", "ts", "close", "prev_high", "prev_low", "prev_close")


@query(
    "prev_trading_day",
    _PREV.format(h=D_SQL, n="d")
    + """ SELECT d.symbol, d.ts, d.close, prev_high, prev_low, prev_close FROM d ASOF LEFT JOIN dd
    ON d.symbol = dd.symbol AND d.ts::DATE > dd.day""",
    "close prev_high prev_low prev_close",
)
def _prev_trading(spark, d):
    return B.prev_day(order_days(spark, d), strict_calendar=False).select(
        "symbol", "ts", "close", "prev_high", "prev_low", "prev_close"
    )


@query(
    "index_intersection",
    f"""WITH {H_SQL}, {P_SQL} SELECT h.symbol, h.ts, h.close, q.best FROM h JOIN
    (SELECT symbol, date_trunc('hour', ts) AS ts, max(probability) AS best FROM p WHERE probability >= 0.5 GROUP BY 1, 2) q
    USING (symbol, ts)""",
    "close best",
)
def _intersection(spark, d):
    best = (
        predictions(spark, d)
        .where("probability >= 0.5")
        .groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
        .agg(F.max("probability").alias("best"))
    )
    return B.align_rows(hourly(spark, d).select("symbol", "ts", "close"), best)


@query(
    "membership_filter",
    f"""WITH {H_SQL}, {P_SQL} SELECT symbol, ts, close FROM h WHERE EXISTS (SELECT 1 FROM p
    WHERE p.symbol = h.symbol AND date_trunc('hour', p.ts) = h.ts AND p.prediction = 1)""",
    "close",
)
def _membership(spark, d):
    index = predictions(spark, d).where("prediction = 1").select(
        "symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    )
    return B.rows_in(hourly(spark, d).select("symbol", "ts", "close"), index)


@query(
    "next_bar_return",
    f"""WITH {H_SQL} SELECT symbol, ts, lead(close) OVER {O} * ((1 - 0.00005::DOUBLE) * (1 - 0.0005::DOUBLE))
    / (close * ((1 + 0.00005::DOUBLE) * (1 + 0.0005::DOUBLE))) - 1 AS next_return FROM h""",
    "next_return",
)
def _next_return(spark, d):
    return B.next_bar_return(hourly(spark, d)).select("symbol", "ts", "next_return")
