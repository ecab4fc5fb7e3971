"""Queries on labels, outcomes, sequences, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.catalog.base import D_SQL, H_SQL, O, hourly, order_days, predictions, query, rows, table
from barspark.functions import indicators as I
from barspark.operators import labels as L
from barspark.operators import sequences as SQ
from barspark.operators import splits as SP
from barspark.operators.model import RobustScale
from barspark.operators.quality import newest_rows
from barspark.session import cut_lineage

_TR = f"""pc AS (SELECT *, lag(close) OVER {O} AS pc FROM h),
  tr AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM pc),
  ha AS (SELECT symbol, ts, open, high, low, close, volume, avg(tr) OVER {rows(14)} AS atr FROM tr),
  hi AS (SELECT *, row_number() OVER {O} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ha)"""


def _labelled(sl: float, tp: float, hold: int, horizon: int, slip: float = 0.0) -> str:
    """Label by joining each bar with the bars of its horizon."""
    return f"""WITH {H_SQL}, {_TR}, e AS (SELECT *, close - atr * {sl!r}::DOUBLE + {slip!r}::DOUBLE AS sl,
    close + atr * {tp!r}::DOUBLE - {slip!r}::DOUBLE AS tp FROM hi WHERE i + {horizon} < n),
    t AS (SELECT e.symbol, e.ts, min(CASE WHEN b.high >= e.tp THEN b.i END) AS up, min(CASE WHEN b.low <= e.sl THEN b.i END) AS dn
    FROM e LEFT JOIN hi b ON b.symbol = e.symbol AND b.i BETWEEN e.i + {hold} AND e.i + {horizon} GROUP BY 1, 2),
    lab AS (SELECT symbol, ts, coalesce((up IS NOT NULL AND (dn IS NULL OR up < dn))::INTEGER, 0) AS label FROM t)"""


for _name, _rows in (("barrier_label", None), ("barrier_label_chunked", 50)):
    query(_name, _labelled(1.0, 2.0, 2, 24, 0.3) + " SELECT * FROM lab")(
        lambda spark, d, r=_rows: L.barrier_label(hourly(spark, d), 1.0, 2.0, 2, 24, 0.3, chunk_rows=r).select(
            "symbol", "ts", "label"
        )
    )


@query(
    "label_rate",
    _labelled(1.0, 2.0, 2, 24)
    + " SELECT symbol, count(*) AS n, sum(label)::BIGINT AS positive, 100.0 * avg(label) AS positive_pct FROM lab GROUP BY 1",
    "positive_pct",
)
def _rate(spark, d):
    lab = L.barrier_label(hourly(spark, d), 1.0, 2.0, 2, 24)
    return lab.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positive"), (100.0 * F.avg("label")).alias("positive_pct")
    )


_PAIRS = [(0.5, 1.0), (1.0, 2.0), (1.5, 3.0), (2.0, 4.0)]


def _sweep_sql() -> str:
    pairs = ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE)" for a, b in _PAIRS)
    return f"""WITH {H_SQL}, {_TR}, e AS (SELECT hi.*, sl, tp FROM hi, (VALUES {pairs}) v(sl, tp) WHERE i + 24 < n),
    t AS (SELECT e.symbol, e.ts, e.sl, e.tp, min(CASE WHEN b.high >= e.close + e.atr * e.tp THEN b.i END) AS up,
    min(CASE WHEN b.low <= e.close - e.atr * e.sl THEN b.i END) AS dn
    FROM e LEFT JOIN hi b ON b.symbol = e.symbol AND b.i BETWEEN e.i + 2 AND e.i + 24 GROUP BY ALL)
    SELECT sl, tp, count(*) AS n, sum((up IS NOT NULL AND (dn IS NULL OR up < dn))::INTEGER)::BIGINT AS positive,
    100.0 * avg((up IS NOT NULL AND (dn IS NULL OR up < dn))::INTEGER) AS positive_pct FROM t GROUP BY 1, 2"""


query("label_sweep", _sweep_sql(), "positive_pct")(lambda spark, d: L.label_sweep(hourly(spark, d), _PAIRS, 2, 24))


def _entries(spark, d):
    """Bars whose ATR is known, as entries."""
    return I.atr(hourly(spark, d), 14, out="atr").where("atr IS NOT NULL").select("symbol", "ts", "close", "atr")


def _first_exit_sql(tie: str, keep: str = "") -> str:
    both = {
        "near_open": "abs(b.open - e.tp) < abs(b.open - e.sl)",
        "loss": "false",
        "tp_first": "true",
    }[tie]
    return f"""WITH {H_SQL}, {_TR}, e AS (SELECT symbol, ts, close, close - atr AS sl, close + 1.8::DOUBLE * atr AS tp
    FROM ha WHERE atr IS NOT NULL),
    f AS (SELECT e.symbol, e.ts, min(b.ts) AS exit_ts FROM e JOIN h b ON b.symbol = e.symbol AND b.ts > e.ts
    AND (b.low <= e.sl OR b.high >= e.tp) GROUP BY 1, 2)
    SELECT e.symbol, e.ts, f.exit_ts, CASE WHEN b.low <= e.sl AND b.high >= e.tp THEN {both} ELSE b.high >= e.tp END AS is_win,
    CASE WHEN CASE WHEN b.low <= e.sl AND b.high >= e.tp THEN {both} ELSE b.high >= e.tp END THEN e.tp ELSE e.sl END AS exit_price
    FROM f JOIN e USING (symbol, ts) JOIN h b ON b.symbol = e.symbol AND b.ts = f.exit_ts"""


for _tie in ("near_open", "loss", "tp_first"):
    query(f"first_exit_{_tie}", _first_exit_sql(_tie), "exit_price")(
        lambda spark, d, t=_tie: L.first_exit(_entries(spark, d), hourly(spark, d), tie=t).select(
            "symbol", "ts", "exit_ts", "is_win", "exit_price"
        )
    )


@query(
    "first_exit_no_atr",
    f"""WITH {H_SQL}, e AS (SELECT symbol, ts, close * 0.999::DOUBLE AS sl, close * 1.002::DOUBLE AS tp FROM h),
    f AS (SELECT e.symbol, e.ts, min(b.ts) AS exit_ts FROM e JOIN h b ON b.symbol = e.symbol AND b.ts > e.ts
    AND (b.low <= e.sl OR b.high >= e.tp) GROUP BY 1, 2)
    SELECT e.symbol, e.ts, f.exit_ts FROM e LEFT JOIN f USING (symbol, ts)""",
)
def _no_atr(spark, d):
    bars = hourly(spark, d)
    return L.first_exit(bars.select("symbol", "ts", "close"), bars, keep_open=True).select("symbol", "ts", "exit_ts")


_SCAN_SQL = f"""WITH {H_SQL}, {_TR}, e AS (SELECT s.symbol, s.ts, s.atr, s.i, s.n, b.ts AS entry_ts, b.open AS entry_price,
  b.open - s.atr AS sl, b.open + 2 * s.atr AS tp FROM hi s LEFT JOIN hi b ON b.symbol = s.symbol AND b.i = s.i + 1),
  t AS (SELECT e.symbol, e.ts, min(b.i) AS hit FROM e JOIN hi b ON b.symbol = e.symbol AND b.i BETWEEN e.i + 4 AND e.i + 48
  AND (b.high >= e.tp OR b.low <= e.sl) GROUP BY 1, 2),
  r AS (SELECT e.*, x.ts AS hit_ts, x.high AS hit_high, y.ts AS end_ts, y.close AS end_close,
  CASE WHEN e.entry_price IS NULL THEN 'Pending' WHEN e.atr IS NULL OR e.atr <= 0 THEN 'InvalidATR' WHEN x.ts IS NULL THEN 'Timeout'
  WHEN x.high >= e.tp THEN 'Win' ELSE 'Loss' END AS outcome
  FROM e LEFT JOIN t USING (symbol, ts) LEFT JOIN hi x ON x.symbol = e.symbol AND x.i = t.hit
  LEFT JOIN hi y ON y.symbol = e.symbol AND y.i = least(e.i + 48, e.n - 1)),
  scanned AS (SELECT symbol, ts, atr, entry_ts, entry_price, outcome, CASE WHEN outcome IN ('Win', 'Loss') THEN hit_ts
  WHEN outcome = 'Timeout' THEN end_ts END AS exit_ts, CASE outcome WHEN 'Win' THEN tp WHEN 'Loss' THEN sl
  WHEN 'Timeout' THEN end_close END AS exit_price,
  CASE outcome WHEN 'Win' THEN tp WHEN 'Loss' THEN sl WHEN 'Timeout' THEN end_close END - entry_price AS profit_loss FROM r)"""


def scanned(spark, d, chunk_rows=None):
    bars = hourly(spark, d)
    signals = I.atr(bars, 14, out="atr").select("symbol", "ts", "atr")
    return L.scan_outcome(signals, bars, min_hold=3, horizon=48, chunk_rows=chunk_rows).select(
        "symbol", "ts", "atr", "entry_ts", "entry_price", "outcome", "exit_ts", "exit_price", "profit_loss"
    )


for _name, _rows in (("scan_outcome", None), ("scan_outcome_chunked", 100)):
    query(_name, _SCAN_SQL + " SELECT * FROM scanned", "atr entry_price exit_price profit_loss")(
        lambda spark, d, r=_rows: scanned(spark, d, r)
    )


_MARK_SQL = f"""WITH {H_SQL}, {_TR}, e AS (SELECT symbol, ts, i, n, close AS entry_price, close - atr AS sl, close + 3 * atr AS tp
  FROM hi WHERE atr IS NOT NULL AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND i < n - 1),
  t AS (SELECT e.symbol, e.ts, min(b.i) AS hit FROM e JOIN hi b ON b.symbol = e.symbol AND b.i BETWEEN e.i + 3 AND e.i + 30
  AND b.ts <= TIMESTAMP '2024-01-20 12:00:00' AND (b.high >= e.tp OR b.low <= e.sl) GROUP BY 1, 2),
  q AS (SELECT e.symbol, e.ts, max(b.i) AS last_i FROM e JOIN hi b ON b.symbol = e.symbol AND b.i BETWEEN e.i + 1 AND e.i + 30
  AND b.ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2)
  SELECT e.symbol, e.ts, CASE WHEN x.ts IS NULL THEN CASE WHEN coalesce(q.last_i, -1) = least(e.i + 30, e.n - 1) THEN 'Timeout' ELSE 'Pending' END
  WHEN x.high >= e.tp THEN 'Win' ELSE 'Loss' END AS outcome,
  coalesce(x.ts, y.ts) AS exit_ts,
  CASE WHEN x.ts IS NULL THEN y.close WHEN x.high >= e.tp THEN e.tp ELSE e.sl END - e.entry_price AS profit_loss
  FROM e LEFT JOIN t USING (symbol, ts) LEFT JOIN q USING (symbol, ts)
  LEFT JOIN hi x ON x.symbol = e.symbol AND x.i = t.hit LEFT JOIN hi y ON y.symbol = e.symbol AND y.i = q.last_i"""


@query("mark_open", _MARK_SQL, "profit_loss")
def _mark(spark, d):
    bars = hourly(spark, d)
    at = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    last = bars.groupBy("symbol").agg(F.max("ts").alias("_l"))
    trades = _entries(spark, d).join(last, "symbol").where((F.col("ts") <= at) & (F.col("ts") < F.col("_l"))).select(
        "symbol",
        "ts",
        F.col("close").alias("entry_price"),
        (F.col("close") - F.col("atr")).alias("sl_price"),
        (F.col("close") + 3 * F.col("atr")).alias("tp_price"),
    )
    out = L.mark_open(trades, bars, "2024-01-20 12:00:00", min_hold=3, horizon=30)
    return out.select("symbol", "ts", "outcome", "exit_ts", "profit_loss")


@query(
    "verify_exits",
    _first_exit_sql("loss").replace("SELECT e.symbol, e.ts, f.exit_ts,", "SELECT e.symbol, e.ts, f.exit_ts, true AS matches,", 1),
    "exit_price",
)
def _verify(spark, d):
    bars, entries = hourly(spark, d), _entries(spark, d)
    listed = L.first_exit(entries, bars, tie="loss").select(
        "symbol", "ts", "sl_price", "tp_price", F.col("exit_ts").alias("expected_exit_ts"), F.col("is_win").alias("expected_win")
    )
    return L.verify_exits(listed, bars).select("symbol", "ts", "exit_ts", "matches", "is_win", "exit_price")


@query(
    "levels",
    f"WITH {H_SQL}, {_TR} SELECT symbol, ts, close - 1.5::DOUBLE * atr AS sl_price, close + 3.0::DOUBLE * atr AS tp_price, 2.0::DOUBLE AS rr FROM ha",
    "sl_price tp_price rr",
)
def _levels(spark, d):
    return L.levels(I.atr(hourly(spark, d), 14, out="atr"), 1.5, 3.0).select("symbol", "ts", "sl_price", "tp_price", "rr")


# -- sequences -------------------------------------------------------------------------------------

_SEQ_SQL = f"""WITH {H_SQL}, x AS (SELECT symbol, ts, list(close) OVER {rows(12)} AS c, list(volume) OVER {rows(12)} AS v FROM h)
  SELECT symbol, ts, list_sum(c) + list_sum(v) AS total, c[1] AS oldest, v[-1] AS newest, len(c) * 2 AS n FROM x WHERE len(c) = 12"""


def _seq_facts(df):
    v = F.col("features")
    return df.select(
        "symbol",
        "ts",
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.get(v, F.lit(0)).alias("oldest"),
        F.element_at(v, -1).alias("newest"),
        F.size(v).cast("long").alias("n"),
    )


for _name, _rows in (("sequence_facts", None), ("sequence_facts_chunked", 40)):
    query(_name, _SEQ_SQL, "total oldest newest")(
        lambda spark, d, r=_rows: _seq_facts(SQ.sequence(hourly(spark, d), ["close", "volume"], 12, chunk_rows=r))
    )


@query(
    "sequences_filtered",
    f"""WITH {H_SQL}, x AS (SELECT symbol, ts, list(close) OVER {rows(12)} AS c, list(volume) OVER {rows(12)} AS v,
    (close - avg(close) OVER {rows(20)}) AS dist FROM h),
    k AS (SELECT * FROM x WHERE len(c) = 12 AND hour(ts) >= 8 AND hour(ts) < 22 AND dist > -0.5 AND v[-1] < 4
    ORDER BY ts DESC, symbol DESC LIMIT 300)
    SELECT symbol, ts, list_sum(c) + list_sum(v) AS total, c[1] AS oldest, v[-1] AS newest, len(c) * 2 AS n FROM k""",
    "total oldest newest",
)
def _filtered(spark, d):
    s = I.sma(hourly(spark, d), "close", 20, out="_m")
    ready = s.withColumns({"dist_sma_200": F.col("close") - F.col("_m"), "adx": F.lit(30.0), "rsi_m5": F.col("volume")})
    return _seq_facts(
        SQ.sequences(ready, ["close", "volume"], 12, session="london_ny", trend=(-0.5, 8.0), pullback=4.0, max_windows=300)
    )


@query(
    "sequence_long",
    f"""WITH {H_SQL}, x AS (SELECT symbol, ts, list(close) OVER {rows(4)} AS c, list(volume) OVER {rows(4)} AS v FROM h),
    l AS (SELECT symbol, ts, c, v, unnest(range(4)) AS k FROM x WHERE len(c) = 4)
    SELECT symbol, ts, (2 * k)::INTEGER AS pos, (3 - k)::INTEGER AS lag, 'close' AS feature, c[k + 1] AS value FROM l
    UNION ALL SELECT symbol, ts, (2 * k + 1)::INTEGER, (3 - k)::INTEGER, 'volume', v[k + 1] FROM l""",
    "value",
)
def _long(spark, d):
    seq = SQ.sequence(hourly(spark, d), ["close", "volume"], 4)
    return SQ.explode_sequence(seq, ["close", "volume"], 4, keep=("symbol", "ts"))


@query(
    "newest_n",
    "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
)
def _newest(spark, d):
    return newest_rows(table(spark, d, "events"), 500, "ts", "event_id").select("event_id", "ts")


@query(
    "robust_scale",
    f"""WITH {H_SQL}, x AS (SELECT symbol, ts, list(close) OVER {rows(6)} AS c FROM h), l AS (SELECT symbol, ts,
    unnest(range(6)) AS pos, c FROM x WHERE len(c) = 6), f AS (SELECT pos, quantile_cont(c[pos + 1], 0.5) AS m,
    quantile_cont(c[pos + 1], 0.75) - quantile_cont(c[pos + 1], 0.25) AS s FROM l GROUP BY 1)
    SELECT symbol, ts, l.pos::INTEGER AS pos, (c[l.pos + 1] - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS value FROM l JOIN f USING (pos)""",
    "value",
)
def _scale(spark, d):
    seq = cut_lineage(SQ.sequence(hourly(spark, d), ["close"], 6))
    return RobustScale.fit(seq).apply(seq).select("symbol", "ts", F.posexplode("features").alias("pos", "value"))


# -- splits ----------------------------------------------------------------------------------------


@query(
    "split_date",
    """SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-12' THEN 'train'
    WHEN ts > TIMESTAMP '2024-01-12' + INTERVAL 2 DAY AND ts <= TIMESTAMP '2024-01-20' THEN 'val'
    WHEN ts > TIMESTAMP '2024-01-20' + INTERVAL 2 DAY AND ts <= TIMESTAMP '2024-01-28' THEN 'test' END AS split
    FROM events WHERE split IS NOT NULL""",
)
def _split_date(spark, d):
    rows_ = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return SP.split_by_date(rows_, "2024-01-12", "2024-01-20", "2024-01-28", 2).select("event_id", "split")


_IDX = f"""ix AS (SELECT event_id, event_type AS symbol, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS idx,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)"""
_FRAC = "CASE WHEN idx < floor(n * 0.7::DOUBLE) THEN 'train' WHEN idx < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split"


def _events(spark, d):
    return predictions(spark, d).select("symbol", "ts", "event_id", "label", "probability")


for _name, _rows in (("split_fraction", None), ("split_fraction_chunked", 200)):
    query(_name, f"WITH {_IDX} SELECT event_id, {_FRAC} FROM ix")(
        lambda spark, d, r=_rows: SP.split_by_fraction(_events(spark, d), chunk_rows=r).select("event_id", "split")
    )

for _anchor, _cond in (
    ("start", "(idx <= c - 1 AND idx > c - 80)"),
    ("end", "(idx > c - 1 AND idx <= c + 78)"),
):
    _first = _cond.replace("c ", "floor(n * 0.7::DOUBLE) ")
    _second = _cond.replace("c ", "floor(n * 0.85::DOUBLE) ")
    query(
        f"purge_{_anchor}",
        f"""WITH {_IDX}, k AS (SELECT event_id, symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx,
        count(*) OVER (PARTITION BY symbol) AS n FROM ix WHERE NOT ({_first} OR {_second}))
        SELECT event_id, {_FRAC} FROM k""",
    )(lambda spark, d, a=_anchor: SP.purge(_events(spark, d), 80, anchor=a).select("event_id", "split"))

_FOLD_SQL = f"""WITH {_IDX}, f AS (SELECT *, n // 6 AS size, unnest(range(5)) AS fold FROM ix),
  g AS (SELECT *, n - (5 - fold) * size AS st FROM f)
  SELECT event_id, idx, fold::INTEGER AS fold, CASE WHEN idx < st - 3 THEN 'train' WHEN idx < st + size // 2 THEN 'val' ELSE 'test' END AS role
  FROM g WHERE (idx < st - 3 AND idx >= st - 3 - 400) OR (idx >= st AND idx < st + size)"""


@query("ts_folds", _FOLD_SQL)
def _folds(spark, d):
    return SP.ts_folds(_events(spark, d), 5, gap=3, max_train=400, halves=True).select("event_id", "idx", "fold", "role")


_WALK_SQL = f"""{_IDX}, w AS (SELECT *, unnest(range((n - 130) // 20 + 1)) AS fold FROM ix),
  wf AS (SELECT symbol, event_id, ts, idx, fold, CASE WHEN idx - fold * 20 >= 100 THEN 'test' WHEN idx - fold * 20 >= 70 THEN 'val'
  ELSE 'train' END AS role FROM w WHERE idx >= fold * 20 AND idx < fold * 20 + 130)"""


def _walk(spark, d):
    return SP.walk_forward(_events(spark, d), 100, 30, 20, inner=0.7)


@query("walk_forward", f"WITH {_WALK_SQL} SELECT event_id, idx, fold, role FROM wf")
def _walk_rows(spark, d):
    return _walk(spark, d).select("event_id", "idx", "fold", "role")


@query(
    "check_folds",
    f"""WITH {_WALK_SQL}, s AS (SELECT symbol, fold, max(ts) FILTER (role = 'train') AS train_max, min(ts) FILTER (role <> 'train') AS test_min,
    min(idx) FILTER (role = 'train') AS train_first, max(idx) FILTER (role = 'train') AS train_last FROM wf GROUP BY 1, 2)
    SELECT *, test_min > train_max AS ordered, train_last - 79 AS last_valid_start, train_last - 79 >= train_first AS window_fits FROM s""",
)
def _check(spark, d):
    return SP.check_folds(_walk(spark, d), 80)


@query(
    "fold_summary",
    f"""WITH {_WALK_SQL}, m AS (SELECT wf.symbol, fold, avg((k > 50)::INTEGER) AS rate FROM wf JOIN (SELECT event_id,
    regexp_extract(props, '"k": ([0-9]+)', 1)::INTEGER AS k FROM events) USING (event_id) WHERE role = 'test' GROUP BY 1, 2)
    SELECT 'rate' AS metric, avg(rate) AS mean, stddev_pop(rate) AS std, min(rate) AS min, max(rate) AS max FROM m""",
    "mean std min max",
)
def _summary(spark, d):
    per = _walk(spark, d).where("role = 'test'").groupBy("symbol", "fold").agg(F.avg("label").alias("rate"))
    return SP.fold_summary(per, ["rate"])


_DAYWIN_SQL = f"""WITH {D_SQL}, sp AS (SELECT *, min(ts) OVER (PARTITION BY symbol) AS t0, max(ts) OVER (PARTITION BY symbol) AS t1 FROM d),
  w AS (SELECT *, unnest(range(100)) AS window_id FROM sp),
  k AS (SELECT symbol, ts, window_id FROM w WHERE ts >= t0 + INTERVAL 180 DAY + window_id * INTERVAL 30 DAY
  AND ts < t0 + INTERVAL 225 DAY + window_id * INTERVAL 30 DAY AND t0 + window_id * INTERVAL 30 DAY < t1),
  ids AS (SELECT symbol, window_id, row_number() OVER (PARTITION BY symbol ORDER BY window_id) - 1 AS r FROM (SELECT DISTINCT symbol, window_id FROM k)),
  stop AS (SELECT symbol, count(*) FILTER (r = window_id) AS run FROM ids GROUP BY 1)
  SELECT symbol, ts, window_id FROM k JOIN stop USING (symbol) WHERE window_id < run"""


@query("walk_forward_days", _DAYWIN_SQL)
def _day_windows(spark, d):
    return SP.walk_forward_days(order_days(spark, d), 180, 45, 30).select("symbol", "ts", "window_id")
