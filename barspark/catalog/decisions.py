"""Queries on thresholds, evaluation and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.catalog.base import H_SQL, O, P_SQL, hourly, predictions, query, rows, table
from barspark.functions import indicators as I
from barspark.functions.regime import RegimeRules, adaptive_threshold, classify_regime, should_trade
from barspark.functions.sizing import confidence, signal_type
from barspark.functions.study import Study
from barspark.operators import gating as G
from barspark.operators import threshold as T

CAP = 20
N = 101
P = T.Payoff(2.0, -1.0)

# -- thresholds ------------------------------------------------------------------------------------

_GRID = f"""gq AS (SELECT unnest(quantile_cont(probability, [{", ".join(f"{i / (N - 1)!r}" for i in range(N))}])) AS q FROM p),
  grid AS (SELECT DISTINCT round(greatest(least(q, 0.99::DOUBLE), 0.001::DOUBLE), 9) AS threshold FROM gq
  UNION SELECT 0.001::DOUBLE UNION SELECT 0.99::DOUBLE)"""


def _grid(p):
    return T.candidate_thresholds(p, N, decimals=9)


query("candidate_thresholds", f"WITH {P_SQL}, {_GRID} SELECT threshold FROM grid", "threshold", 8)(
    lambda spark, d: _grid(predictions(spark, d))
)

_TOPK = f"SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY ts::DATE ORDER BY probability DESC, ts) <= {CAP}"
query("daily_topk", f"WITH {P_SQL}, k AS ({_TOPK}) SELECT event_id, probability FROM k", "probability")(
    lambda spark, d: T.daily_topk(predictions(spark, d), CAP).select("event_id", "probability")
)
query(
    "daily_topk_threshold",
    f"WITH {P_SQL}, k AS ({_TOPK.replace('FROM p', 'FROM p WHERE probability >= 0.4')}) SELECT event_id, probability FROM k",
    "probability",
)(lambda spark, d: T.daily_topk(predictions(spark, d), CAP, threshold=0.4).select("event_id", "probability"))

query(
    "max_recall",
    f"""WITH {P_SQL} SELECT count(DISTINCT ts::DATE) AS days, sum(label)::BIGINT AS positives,
    least(1.0::DOUBLE, {CAP} * count(DISTINCT ts::DATE) / sum(label)) AS max_recall FROM p""",
    "max_recall",
)(lambda spark, d: T.max_recall(predictions(spark, d), CAP))


def _sweep_sql(cap: bool) -> str:
    """One brute-force count per threshold."""
    src = f"({_TOPK})" if cap else "p"
    return f"""{P_SQL}, {_GRID}, src AS (SELECT * FROM {src} AS z),
    c AS (SELECT threshold, count(probability) AS trades, coalesce(sum(label), 0)::BIGINT AS tp
      FROM grid LEFT JOIN src ON probability >= threshold GROUP BY 1),
    tot AS (SELECT count(*) AS n_rows, sum(label)::BIGINT AS positives FROM p),
    r AS (SELECT *, trades - tp AS fp, CASE WHEN trades > 0 THEN tp / trades ELSE 0 END AS precision, tp / positives AS recall,
      CASE WHEN trades + positives > 0 THEN 2 * tp / (trades + positives) ELSE 0 END AS f1 FROM c, tot),
    sw AS (SELECT threshold, trades, tp, fp, n_rows, positives, precision, recall, f1,
      precision * 2 - (1 - precision) AS ev_per_trade, (precision * 2 - (1 - precision)) * trades AS ev_total FROM r)"""


_SW = "threshold precision recall f1 ev_per_trade ev_total"


def _swept(spark, d, cap):
    p = predictions(spark, d)
    return T.sweep(p, _grid(p), CAP if cap else None, payoff=P)


for _name, _cap in (("sweep", False), ("sweep_capped", True)):
    query(_name, f"WITH {_sweep_sql(_cap)} SELECT * FROM sw", _SW)(lambda spark, d, c=_cap: _swept(spark, d, c))

_EV_ORDER = "round(ev_total, 8) DESC, round(ev_per_trade, 8) DESC, round(recall, 8) DESC, threshold"


def _pick(order: str, where: str, cap: bool = False) -> str:
    return f"WITH {_sweep_sql(cap)} SELECT threshold, trades, precision, recall FROM sw WHERE {where} ORDER BY {order} LIMIT 1"


_MIN10 = "trades >= greatest(10, ceil(n_rows * 0.001))"
_MIN25 = "trades >= greatest(25, ceil(n_rows * 0.002))"
_PICKED = ("threshold", "trades", "precision", "recall")
_PR = "threshold precision recall"

query("pick_ev", _pick(_EV_ORDER, _MIN10), _PR)(lambda spark, d: T.pick_ev(_swept(spark, d, False)).select(*_PICKED))
query("pick_ev_capped", _pick(_EV_ORDER, _MIN10, True), _PR)(
    lambda spark, d: T.pick_ev(_swept(spark, d, True)).select(*_PICKED)
)
query("pick_hybrid", _pick(_EV_ORDER, f"{_MIN10} AND precision >= 0.4 AND recall >= 0.15"), _PR)(
    lambda spark, d: T.pick_hybrid(_swept(spark, d, False), 0.4, 0.15).select(*_PICKED)
)
query("pick_hybrid_fallback", _pick("f1 DESC, threshold", _MIN10), _PR)(
    lambda spark, d: T.pick_hybrid(_swept(spark, d, False), 0.95, 0.9).select(*_PICKED)
)


@query(
    "pick_hybrid_bounded",
    f"""WITH {_sweep_sql(True)}, b AS (SELECT least(1.0, {CAP} * count(DISTINCT ts::DATE) / sum(label)) AS most FROM p)
    SELECT threshold, trades, precision, recall FROM sw, b WHERE {_MIN10} AND precision >= 0.3 AND recall >= least(0.02::DOUBLE, most)
    ORDER BY {_EV_ORDER} LIMIT 1""",
    _PR,
)
def _bounded(spark, d):
    p = predictions(spark, d)
    return T.pick_hybrid(_swept(spark, d, True), 0.3, 0.02, recall_bound=T.max_recall(p, CAP)).select(*_PICKED)


query("pick_f1", _pick("round(f1, 8) DESC, round(recall, 8) DESC, threshold", f"{_MIN25} AND precision >= 0.45"), _PR)(
    lambda spark, d: T.pick_f1(_swept(spark, d, False), 0.45).select(*_PICKED)
)
query(
    "pick_f1_fallback", _pick("round(precision, 8) DESC, round(recall, 8) DESC, threshold", _MIN25), _PR
)(lambda spark, d: T.pick_f1(_swept(spark, d, False), 0.999).select(*_PICKED))

for _mode, _order, _where in (
    ("f1", "f1 DESC, threshold", _MIN10),
    ("ev", "ev_total DESC, threshold", _MIN10),
    ("hybrid", "ev_total DESC, threshold", f"{_MIN10} AND precision >= 0.4 AND recall >= 0.3"),
):
    query(
        f"optimize_threshold_{_mode}",
        f"""WITH {_sweep_sql(False)} SELECT threshold, trades, precision, recall,
        {"f1" if _mode == "f1" else "ev_total"} AS score FROM sw WHERE {_where} ORDER BY {_order} LIMIT 1""",
        _PR + " score",
    )(
        lambda spark, d, m=_mode: T.optimize_threshold(
            _swept(spark, d, False), mode=m, min_precision=0.4, min_recall=0.3
        ).select(*_PICKED, "score")
    )

_RANK = """v AS (SELECT probability, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY 1),
  c AS (SELECT *, sum(neg) OVER (ORDER BY probability) - neg AS neg_below, sum(pos) OVER (ORDER BY probability DESC) AS tp,
  sum(neg) OVER (ORDER BY probability DESC) AS fp, sum(pos) OVER () AS p_all, sum(neg) OVER () AS n_all FROM v),
  rq AS (SELECT sum(pos * (neg_below + neg / 2)) / any_value(p_all * n_all) AS roc_auc,
  sum(pos / p_all * tp / (tp + fp)) AS pr_auc, sum(pos / p_all * (tp / (tp + fp) +
  CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1 END) / 2) AS pr_auc_trapezoid FROM c)"""
for _name in ("ranking_quality", "ranking_quality_ranges"):
    query(_name, f"WITH {P_SQL}, {_RANK} SELECT * FROM rq", "roc_auc pr_auc pr_auc_trapezoid")(
        lambda spark, d: T.ranking_quality(predictions(spark, d))
    )

_FIXED = "threshold roc_auc pr_auc lowest_selected win_rate precision recall f1"


def _fixed_sql(cap: bool) -> str:
    src = f"({_TOPK.replace('FROM p', 'FROM p WHERE probability >= 0.3')})" if cap else "(SELECT * FROM p WHERE probability >= 0.3)"
    return f"""WITH {P_SQL}, {_RANK}, c2 AS (SELECT count(*) AS trades, sum(label)::BIGINT AS tp, min(probability) AS lowest_selected
    FROM {src} AS z), tot AS (SELECT count(*) AS n_rows, sum(label)::BIGINT AS positives FROM p)
    SELECT 0.3::DOUBLE AS threshold, n_rows, positives, trades, tp, lowest_selected, roc_auc, pr_auc, trades - tp AS fp,
    positives - tp AS fn, n_rows - positives - trades + tp AS tn, tp / trades AS win_rate, tp / trades AS precision,
    tp / positives AS recall, 2 * tp / (trades + positives) AS f1 FROM c2, tot, rq"""


for _name, _cap in (("evaluate_fixed", False), ("evaluate_fixed_capped", True)):
    query(_name, _fixed_sql(_cap), _FIXED)(
        lambda spark, d, c=_cap: T.evaluate_fixed(predictions(spark, d), 0.3, CAP if c else None)
    )


@query(
    "evaluate_ev_capped",
    f"""WITH {_sweep_sql(True)}, {_RANK.replace("c AS (", "c3 AS (").replace("FROM c)", "FROM c3)")},
    best AS (SELECT threshold AS t FROM sw WHERE {_MIN10} ORDER BY {_EV_ORDER} LIMIT 1),
    sel AS (SELECT z.* FROM ({_TOPK}) AS z, best WHERE probability >= t)
    SELECT min(probability) AS threshold, count(*) AS trades, sum(label)::BIGINT AS tp, any_value(roc_auc) AS roc_auc FROM sel, rq""",
    "threshold roc_auc",
)
def _evaluate(spark, d):
    # The grid's size is the default one, so the SQL's shorter grid picks inside the same capped rows.
    p = predictions(spark, d)
    table_ = T.sweep(p, _grid(p), CAP, payoff=P)
    best = T.pick_ev(table_)
    out = T.evaluate_fixed(p, best, CAP)
    return out.select(F.col("lowest_selected").alias("threshold"), "trades", "tp", "roc_auc")


_PCT = (0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100)


@query(
    "probability_profile",
    f"WITH {P_SQL}, "
    + "s AS ("
    + " UNION ALL ".join(f"SELECT 'p{x}' AS statistic, quantile_cont(probability, {x / 100!r}) AS value FROM p" for x in _PCT)
    + """ UNION ALL SELECT 'count', count(*)::DOUBLE FROM p UNION ALL SELECT 'share_ge_threshold', avg((probability >= 0.6)::INTEGER) FROM p
    UNION ALL SELECT 'share_ge_half', avg((probability >= 0.5)::INTEGER) FROM p UNION ALL SELECT 'mean', avg(probability) FROM p)
    SELECT * FROM s""",
    "value",
)
def _profile(spark, d):
    return T.probability_profile(predictions(spark, d), 0.6)


query(
    "top_probabilities",
    f"WITH {P_SQL} SELECT event_id, probability FROM p ORDER BY probability DESC, ts LIMIT 20",
    "probability",
)(lambda spark, d: T.top_probabilities(predictions(spark, d), 20).select("event_id", "probability"))

query(
    "reason_counts",
    f"""WITH {P_SQL} SELECT CASE WHEN hour(ts) < 8 OR hour(ts) >= 22 THEN 'session' WHEN probability < 0.3 THEN 'probability'
    WHEN symbol = 'error' THEN 'symbol' ELSE 'signal' END AS reason, count(*) AS n FROM p GROUP BY 1""",
)(
    lambda spark, d: T.reason_counts(
        predictions(spark, d),
        {
            "session": (F.hour("ts") < 8) | (F.hour("ts") >= 22),
            "probability": F.col("probability") < 0.3,
            "symbol": F.col("symbol") == "error",
        },
    )
)

query(
    "confidence",
    f"""WITH {P_SQL}, c AS (SELECT CASE WHEN probability >= 0.7 OR probability <= 0.3 THEN 'high'
    WHEN probability >= 0.55 OR probability <= 0.45 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN prediction = 1 THEN CASE WHEN probability >= 0.6 THEN 'BUY' ELSE 'BUY_LOW_CONFIDENCE' END ELSE 'SELL' END AS signal FROM p)
    SELECT confidence, signal, count(*) AS n FROM c GROUP BY 1, 2""",
)(
    lambda spark, d: predictions(spark, d)
    .groupBy(
        confidence(F.col("probability")).alias("confidence"),
        signal_type(F.col("prediction"), F.col("probability"), F.lit(0.6)).alias("signal"),
    )
    .agg(F.count(F.lit(1)).alias("n"))
)

# Documents with labels: probability from length, label from quality.
_DOC = """p AS (SELECT d.doc_id, least(d.n_chars / 4000, 1.0)::DOUBLE AS probability, l.quality AS label, TIMESTAMP '2024-01-01' AS ts
  FROM documents d JOIN labels l USING (doc_id))"""


@query("document_ranking", f"WITH {_DOC}, {_RANK} SELECT * FROM rq", "roc_auc pr_auc pr_auc_trapezoid")
def _documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return T.ranking_quality(
        docs.select(F.least(F.col("n_chars") / 4000, F.lit(1.0)).alias("probability"), F.col("quality").alias("label"))
    )


# -- regimes ---------------------------------------------------------------------------------------

RULES = RegimeRules(high_atr=70.0, mod_atr=55.0, low_atr=40.0, min_atr=45.0, min_adx=12.0, min_dist=-5.0)

_REG = f"""pc AS (SELECT *, lag(close) OVER {O} AS pc, lag(high) OVER {O} AS ph, lag(low) OVER {O} AS pl FROM h),
  tr AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
  CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm FROM pc),
  di AS (SELECT *, 100 * (avg(pdm) OVER {rows(14)} / (avg(tr) OVER {rows(14)} + 1e-9::DOUBLE)) AS pdi,
  100 * (avg(mdm) OVER {rows(14)} / (avg(tr) OVER {rows(14)} + 1e-9::DOUBLE)) AS mdi, avg(tr) OVER {rows(14)} AS atr_raw FROM tr),
  rg AS (SELECT symbol, ts, close, round(atr_raw, 6) AS atr_m5,
  round(avg(100 * abs(pdi - mdi) / (pdi + mdi + 1e-9::DOUBLE)) OVER {rows(14)}, 6) AS adx,
  round(avg(close) OVER {rows(200)}, 6) AS sma_200,
  round(least(close / 200, 1.0), 6) AS probability, (round(least(close / 200, 1.0), 6) >= 0.3)::INTEGER AS prediction,
  (lead(close) OVER {O} > close)::INTEGER AS label FROM di)"""
_TIER = """CASE WHEN coalesce(atr_m5 > 0 AND adx >= 0, false) = false THEN 'TIER4_VERY_LOW_ATR' WHEN atr_m5 >= 70 THEN 'TIER1_HIGH_ATR'
  WHEN atr_m5 >= 55 THEN 'TIER2_MOD_ATR' WHEN atr_m5 >= 40 THEN 'TIER3_LOW_ATR' ELSE 'TIER4_VERY_LOW_ATR' END"""
_ALLOW = "coalesce(atr_m5 >= 45 AND adx >= 12 AND close - sma_200 >= -5, false)"


def regime_rows(spark, d):
    s = Study()
    s.out("_atr", s.atr(14))
    s.out("_adx", s.adx(14)[0])
    s.out("_sma", s.mean("close", 200))
    s.put("_next", [], lambda line: line.next("close"), ahead=1, keep=True)
    out = s.apply(hourly(spark, d))
    p = F.round(F.least(F.col("close") / 200, F.lit(1.0)), 6)
    return out.select(
        "symbol",
        "ts",
        "close",
        F.round("_atr", 6).alias("atr_m5"),
        F.round("_adx", 6).alias("adx"),
        F.round("_sma", 6).alias("sma_200"),
        p.alias("probability"),
        (p >= 0.3).cast("int").alias("prediction"),
        (F.col("_next") > F.col("close")).cast("int").alias("label"),
    )


_COLS = ("atr_m5", "adx", "close", "sma_200")


@query(
    "regime_class",
    f"""WITH {H_SQL}, {_REG} SELECT symbol, ts, {_TIER} AS regime, close - sma_200 AS dist,
    coalesce(atr_m5 > 0 AND adx >= 0 AND close - sma_200 > 0 AND adx > 12, false) AS in_uptrend FROM rg""",
    "dist",
    5,
)
def _class(spark, d):
    out = regime_rows(spark, d).withColumn("_r", classify_regime(*[F.col(c) for c in _COLS], RULES))
    return out.select("symbol", "ts", "_r.regime", "_r.dist", "_r.in_uptrend")


@query(
    "regime_gate",
    f"""WITH {H_SQL}, {_REG} SELECT symbol, ts, {_TIER} AS regime, {_ALLOW} AS allowed,
    concat_ws(' + ', CASE WHEN atr_m5 < 45 THEN printf('Low ATR (%.1f < 45.0)', atr_m5 + 1e-7) ELSE printf('ATR OK (%.1f)', atr_m5 + 1e-7) END,
    CASE WHEN adx < 12 THEN printf('No trend (ADX %.1f < 12.0)', adx + 1e-7) ELSE printf('Trend OK (ADX %.1f)', adx + 1e-7) END,
    CASE WHEN close - sma_200 < -5 THEN printf('Not uptrend (dist %.1f < -5.0)', round(close - sma_200, 6) + sign(close - sma_200) * 1e-7)
    ELSE printf('Uptrend OK (dist %.1f)', round(close - sma_200, 6) + sign(close - sma_200) * 1e-7) END) AS reason FROM rg WHERE atr_m5 IS NOT NULL AND adx IS NOT NULL""",
)
def _gate(spark, d):
    ready = regime_rows(spark, d).where("atr_m5 IS NOT NULL AND adx IS NOT NULL")
    out = ready.withColumn("_r", should_trade(*[F.col(c) for c in _COLS], RULES))
    return out.select("symbol", "ts", "_r.regime", "_r.allowed", "_r.reason")


query(
    "adaptive_threshold",
    f"""WITH {H_SQL}, {_REG} SELECT CASE WHEN atr_m5 >= 70 THEN 0.35::DOUBLE WHEN atr_m5 >= 55 THEN 0.5 ELSE 0.65 END AS threshold,
    count(*) AS n FROM rg GROUP BY 1""",
    "threshold",
)(
    lambda spark, d: regime_rows(spark, d)
    .groupBy(adaptive_threshold(F.col("atr_m5"), RULES).alias("threshold"))
    .agg(F.count(F.lit(1)).alias("n"))
)

query("regime_filter", f"WITH {H_SQL}, {_REG} SELECT symbol, ts FROM rg WHERE atr_m5 >= 45 AND coalesce(adx, 15) >= 12 AND close - sma_200 >= -5")(
    lambda spark, d: G.filter_by_regime(regime_rows(spark, d), rules=RULES).select("symbol", "ts")
)

_TIER_ROW = _TIER.replace("adx >= 0", "coalesce(adx, 15) >= 0")
query(
    "regime_counts",
    f"""WITH {H_SQL}, {_REG} SELECT {_TIER_ROW} AS regime, count(*) AS n,
    count(*) FILTER (atr_m5 >= 45 AND coalesce(adx, 15) >= 12 AND close - sma_200 >= -5) AS kept FROM rg GROUP BY 1""",
)(lambda spark, d: G.regime_counts(regime_rows(spark, d), rules=RULES))

_GATED = f"""rr AS (SELECT symbol, ts, close, coalesce(atr_m5, 10) AS atr_m5, coalesce(adx, 10) AS adx, sma_200, probability, prediction,
  label FROM rg), gt AS (SELECT *, ({_ALLOW} AND probability >= CASE WHEN atr_m5 >= 70 THEN 0.35 WHEN atr_m5 >= 55 THEN 0.5
  ELSE 0.65 END)::INTEGER AS gated, {_TIER} AS regime FROM rr)"""


def _gated(spark, d):
    return G.gate_predictions(regime_rows(spark, d), rules=RULES)


query("gated_predictions", f"WITH {H_SQL}, {_REG}, {_GATED} SELECT symbol, ts, gated, regime FROM gt")(
    lambda spark, d: _gated(spark, d).select("symbol", "ts", "gated", "regime")
)

_NAMES = ("TIER1_HIGH_ATR", "TIER2_MOD_ATR", "TIER3_LOW_ATR", "TIER4_VERY_LOW_ATR")
_REPORT = f"""WITH {H_SQL}, {_REG}, {_GATED}, rep AS (SELECT count(*) AS n, count(*) FILTER (prediction = 1) AS generated,
  count(*) FILTER (prediction = 1 AND gated = 0) AS suppressed, count(*) FILTER (gated = 1) AS executed, """ + ", ".join(
    f"avg((regime = '{name}')::INTEGER) AS tier{i}_share, avg(probability) FILTER (regime = '{name}') AS tier{i}_confidence"
    for i, name in enumerate(_NAMES, 1)
) + ", count(*) FILTER (prediction = 1 AND gated = 0) / greatest(count(*) FILTER (prediction = 1), 1) AS suppression_rate FROM gt)"
_SHARES = " ".join(f"tier{i}_{x}" for i in range(1, 5) for x in ("share", "confidence")) + " suppression_rate"
query("suppression_report", _REPORT + " SELECT * FROM rep", _SHARES)(lambda spark, d: G.suppression_report(_gated(spark, d)))

query(
    "regime_alerts",
    _REPORT
    + """ SELECT 'suppression_rate_too_high' AS alert, suppression_rate AS value, 0.5::DOUBLE AS bound FROM rep WHERE suppression_rate > 0.5
    UNION ALL SELECT 'suppression_rate_too_low', suppression_rate, 0.2 FROM rep WHERE suppression_rate < 0.2
    UNION ALL SELECT 'high_tier1_share', tier1_share, 0.6 FROM rep WHERE tier1_share > 0.6
    UNION ALL SELECT 'low_tier1_share', tier1_share, 0.1 FROM rep WHERE tier1_share < 0.1""",
    "value bound",
)(lambda spark, d: G.regime_alerts(G.suppression_report(_gated(spark, d))))

query(
    "compare_gating",
    f"""WITH {H_SQL}, {_REG}, {_GATED}, f AS (SELECT symbol, count(*) FILTER (prediction = 1) AS trades_base,
    count(*) FILTER (prediction = 1 AND label = 1) AS wins_base, count(*) FILTER (gated = 1) AS trades_gated,
    count(*) FILTER (gated = 1 AND label = 1) AS wins_gated, count(*) FILTER (label = 1) AS positives FROM gt GROUP BY 1),
    r AS (SELECT *, coalesce(wins_base / nullif(trades_base, 0), 0) AS precision_base, coalesce(wins_base / nullif(positives, 0), 0) AS recall_base,
    coalesce(wins_gated / nullif(trades_gated, 0), 0) AS precision_gated, coalesce(wins_gated / nullif(positives, 0), 0) AS recall_gated FROM f)
    SELECT *, trades_base - trades_gated AS trades_removed, coalesce(100.0 * (trades_base - trades_gated) / nullif(trades_base, 0), 0) AS removed_pct,
    precision_gated - precision_base AS precision_change, 100.0 * (precision_gated - precision_base) / nullif(precision_base, 0) AS precision_change_pct
    FROM r""",
    "precision_base recall_base precision_gated recall_gated removed_pct precision_change precision_change_pct",
)(lambda spark, d: G.compare_gating(_gated(spark, d), group=("symbol",)))
