"""Decision thresholds: candidates, one-pass sweep, daily cap, choices and evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.plans.scan import exact_quantiles, value_scan

# Grid bounds and size, and the threshold used when nothing qualifies.
GRID_SIZE, GRID_MIN, GRID_MAX, FALLBACK = 401, 0.001, 0.99, 0.5


@dataclass(frozen=True)
class Payoff:
    win: float = 1.0
    loss: float = -1.0


def candidate_thresholds(
    df: DataFrame,
    n: int = GRID_SIZE,
    *,
    p: str = "probability",
    lo: float = GRID_MIN,
    hi: float = GRID_MAX,
    decimals: int | None = None,
) -> DataFrame:
    """Sorted-unique quantile grid of the probabilities, clipped to [lo, hi] with both ends present."""
    steps = max(11, int(n)) - 1
    grid = exact_quantiles(df, p, [i / steps for i in range(steps + 1)])
    t = F.greatest(F.least(F.col("q"), F.lit(hi)), F.lit(lo))
    clipped = grid.agg(F.collect_set(F.round(t, decimals) if decimals is not None else t).alias("_t"))
    ends = F.array(F.lit(lo), F.lit(hi))
    return clipped.select(F.explode(F.array_sort(F.array_union("_t", ends))).alias("threshold"))


def daily_topk(
    df: DataFrame, k: int, *, p: str = "probability", ts: str = "ts", threshold: float | None = None, tie: str | None = None
) -> DataFrame:
    """The k most probable rows of each day (ties: earlier first).

    The rank filter is pushed below the shuffle by Spark, so a hot day sends k rows per task.
    """
    if threshold is not None:
        df = df.where(F.col(p) >= threshold)
    order = [F.col(p).desc(), F.col(ts)] + ([F.col(tie)] if tie else [])
    w = Window.partitionBy(F.to_date(ts)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def max_recall(df: DataFrame, cap: int, *, y: str = "label", ts: str = "ts") -> DataFrame:
    """One row: the most recall that ``cap`` trades a day allow."""
    facts = df.groupBy(F.to_date(ts).alias("_d")).agg(F.sum(y).alias("_pos")).agg(
        F.count(F.lit(1)).alias("days"), F.coalesce(F.sum("_pos"), F.lit(0)).alias("positives")
    )
    bound = F.when(F.col("positives") > 0, F.least(F.lit(1.0), cap * F.col("days") / F.col("positives"))).otherwise(1.0)
    return facts.withColumn("max_recall", bound)


def _rates(payoff: Payoff) -> dict[str, Column]:
    tp, trades, pos = F.col("tp"), F.col("trades"), F.col("positives")
    precision = F.coalesce(F.try_divide(tp, trades), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, pos), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * tp, trades + pos), F.lit(0.0))
    per_trade = precision * payoff.win + (1 - precision) * payoff.loss
    return {
        "precision": precision,
        "recall": recall,
        "f1": f1,
        "ev_per_trade": per_trade,
        "ev_total": per_trade * trades,
    }


def sweep(
    df: DataFrame,
    thresholds: DataFrame,
    cap: int | None = None,
    *,
    p: str = "probability",
    y: str = "label",
    ts: str = "ts",
    tie: str | None = None,
    payoff: Payoff = Payoff(),
) -> DataFrame:
    """Trades, tp, fp, precision, recall, F1 and expected value for every threshold in one pass.

    The day rank does not depend on the threshold, so the cap is one filter. Thresholds and rows are ranked
    together: what a threshold selects is all rows less those below it. The grid may be of any length.
    """
    rows = daily_topk(df, cap, p=p, ts=ts, tie=tie) if cap else df
    zero, one = (F.lit(n).cast("long") for n in (0, 1))
    values = rows.select(F.col(p).cast("double").alias("threshold"), one.alias("_n"), F.col(y).cast("long").alias("_tp"), zero.alias("_grid"))
    grid = thresholds.where("threshold is not null").select(F.col("threshold").cast("double").alias("threshold"), zero.alias("_n"), zero.alias("_tp"), one.alias("_grid"))
    scan = value_scan(values.unionByName(grid), "threshold", ["_n", "_tp", "_grid"])
    whole = scan.agg(F.struct(F.sum("_n").alias("n"), F.coalesce(F.sum("_tp"), zero).alias("tp")).alias("a"))
    facts = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(y), F.lit(0)).alias("pos")).alias("s"))
    summed = scan.where("_grid > 0").withColumn("_a", whole.scalar()).select(
        "threshold", (F.col("_a.n") - F.col("_n_below")).alias("trades"), (F.col("_a.tp") - F.col("_tp_below")).alias("tp")
    )
    out = (
        summed.withColumn("_s", facts.scalar())
        .select("threshold", "trades", "tp", (F.col("trades") - F.col("tp")).alias("fp"), F.col("_s.n").alias("n_rows"), F.col("_s.pos").alias("positives"))
    )
    return out.withColumns(_rates(payoff))


def _min_trades(given: int | None, floor: int, share: float) -> Column:
    return F.lit(given) if given is not None else F.greatest(F.lit(floor), F.ceil(F.col("n_rows") * share))


def _choose(table: DataFrame, tiers: list[tuple[Column, list[Column]]]) -> DataFrame:
    """Best row of the first tier that has any (tiers: condition, values to maximise in turn); a default row when none has.

    One aggregate over the table: rows carry their first tier, and the best pair of tier and values wins.
    """
    tier = F.coalesce(*[F.when(ok, F.lit(rank)) for rank, (ok, _) in enumerate(tiers)])
    marked = table.withColumn("tier", tier)
    value = F.coalesce(*[F.when(F.col("tier") == rank, F.array(*[v.cast("double") for v in values])) for rank, (_, values) in enumerate(tiers)])
    rank = F.when(F.col("tier").isNotNull(), F.struct((-F.col("tier")).alias("t"), value.alias("v")))
    best = marked.agg(F.max_by(F.struct(*table.columns, "tier"), rank).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 0")
    fallback = {c: F.lit(FALLBACK if c == "threshold" else None).cast(t) for c, t in table.dtypes}
    cols = [F.when(F.col("b").isNull(), fallback[c]).otherwise(F.col("b")[c]).alias(c) for c in table.columns]
    return best.select(*cols, F.coalesce(F.col("b.tier"), F.lit(len(tiers))).alias("tier"))


def _best(*cols: str) -> list[Column]:
    """Values compared after rounding, so nearly equal scores count as ties; then the lower threshold."""
    return [F.round(c, 8) for c in cols] + [-F.col("threshold")]


def pick_ev(table: DataFrame, min_trades: int | None = None) -> DataFrame:
    """Highest total expected value; ties: per trade, recall, lower threshold."""
    ok = F.col("trades") >= _min_trades(min_trades, 10, 0.001)
    return _choose(table, [(ok, _best("ev_total", "ev_per_trade", "recall"))])


def pick_hybrid(
    table: DataFrame,
    min_precision: float = 0.55,
    min_recall: float = 0.15,
    min_trades: int | None = None,
    *,
    recall_bound: DataFrame | None = None,
) -> DataFrame:
    """Expected value under precision and recall floors; else best F1.

    ``recall_bound`` (from ``max_recall``) lowers an unreachable recall floor.
    """
    floor = F.lit(min_recall)
    if recall_bound is not None:
        floor = F.least(floor, recall_bound.select("max_recall").scalar())
    enough = F.col("trades") >= _min_trades(min_trades, 10, 0.001)
    ok = enough & (F.col("precision") >= min_precision) & (F.col("recall") >= floor)
    return _choose(
        table, [(ok, _best("ev_total", "ev_per_trade", "recall")), (enough, [F.col("f1"), -F.col("threshold")])]
    )


def pick_f1(table: DataFrame, min_precision: float = 0.85, min_trades: int | None = None) -> DataFrame:
    """Best F1 above a precision floor; else best precision, then recall."""
    enough = F.col("trades") >= _min_trades(min_trades, 25, 0.002)
    return _choose(
        table,
        [(enough & (F.col("precision") >= min_precision), _best("f1", "recall")), (enough, _best("precision", "recall"))],
    )


def optimize_threshold(
    table: DataFrame,
    *,
    mode: str = "f1",
    min_precision: float = 0.65,
    min_recall: float = 0.40,
    min_trades: int | None = None,
) -> DataFrame:
    """Validation-set choice: first best score of the mode (f1, ev or hybrid), with its score column."""
    if mode not in ("f1", "ev", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    enough = F.col("trades") >= _min_trades(min_trades, 10, 0.001)
    score = "f1" if mode == "f1" else "ev_total"
    best_first = [F.col(score), -F.col("threshold")]
    if mode == "hybrid":
        ok = enough & (F.col("precision") >= min_precision) & (F.col("recall") >= min_recall)
        tiers = [(ok, best_first), (enough, [F.col("f1"), -F.col("threshold")])]
        value = F.when(F.col("tier") == 0, F.col("ev_total")).otherwise(F.col("f1"))
    else:
        tiers = [(enough, best_first)]
        value = F.col(score)
    return _choose(table, tiers).withColumn("score", value)


def ranking_quality(df: DataFrame, *, p: str = "probability", y: str = "label") -> DataFrame:
    """One row: ROC-AUC (average ranks), average precision and trapezoid PR-AUC; null with one class."""
    marked = df.select(
        F.col(p).alias("_p"), F.col(y).cast("long").alias("_pos"), (1 - F.col(y)).cast("long").alias("_neg")
    )
    scan = value_scan(marked, "_p", ["_pos", "_neg"])
    total = marked.agg(F.struct(F.sum("_pos").alias("p"), F.sum("_neg").alias("n")).alias("t"))
    s = scan.withColumn("_t", total.scalar())
    pos, neg, P, N = F.col("_pos"), F.col("_neg"), F.col("_t.p"), F.col("_t.n")
    tp, fp = P - F.col("_pos_below"), N - F.col("_neg_below")
    here = F.try_divide(tp, tp + fp)
    above = F.coalesce(F.try_divide(tp - pos, tp + fp - pos - neg), F.lit(1.0))
    both = (P > 0) & (N > 0)
    return s.agg(
        F.sum(F.when(both, pos * (F.col("_neg_below") + neg / 2.0) / (P * N))).alias("roc_auc"),
        F.sum(F.when(both, pos / P * here)).alias("pr_auc"),
        F.sum(F.when(both, pos / P * (here + above) / 2.0)).alias("pr_auc_trapezoid"),
    )


def evaluate_fixed(
    df: DataFrame,
    threshold: float | DataFrame,
    cap: int | None = None,
    *,
    p: str = "probability",
    y: str = "label",
    ts: str = "ts",
    tie: str | None = None,
) -> DataFrame:
    """One row of metrics at a given threshold (a number or a one-row frame with ``threshold``)."""
    t = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold.select("threshold").scalar()
    if cap:
        # Day ranks among rows above the threshold equal the overall day ranks.
        picked = daily_topk(df.where(F.col(p) >= t), cap, p=p, ts=ts, tie=tie)
    else:
        picked = df.where(F.col(p) >= t)
    chosen = picked.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(y), F.lit(0)).alias("tp"), F.min(p).alias("lowest")
        ).alias("c")
    )
    quality = ranking_quality(df, p=p, y=y).agg(
        F.struct(F.first("roc_auc").alias("roc_auc"), F.first("pr_auc").alias("pr_auc")).alias("q")
    )
    facts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(y), F.lit(0)).alias("positives"))
    full = facts.withColumns({"_c": chosen.scalar(), "_q": quality.scalar(), "threshold": t}).select(
        "threshold",
        "n_rows",
        "positives",
        F.col("_c.n").alias("trades"),
        F.col("_c.tp").alias("tp"),
        F.col("_c.lowest").alias("lowest_selected"),
        F.col("_q.roc_auc").alias("roc_auc"),
        F.col("_q.pr_auc").alias("pr_auc"),
    )
    rates = _rates(Payoff())
    return full.withColumns(
        {
            "fp": F.col("trades") - F.col("tp"),
            "fn": F.col("positives") - F.col("tp"),
            "tn": F.col("n_rows") - F.col("positives") - F.col("trades") + F.col("tp"),
            "win_rate": rates["precision"],
            **{k: rates[k] for k in ("precision", "recall", "f1")},
        }
    )


def evaluate(
    df: DataFrame,
    *,
    mode: str = "hybrid",
    cap: int | None = None,
    min_precision: float = 0.85,
    min_recall: float = 0.15,
    min_trades: int | None = None,
    payoff: Payoff = Payoff(),
    p: str = "probability",
    y: str = "label",
    ts: str = "ts",
    tie: str | None = None,
    decimals: int | None = None,
) -> DataFrame:
    """Choose a threshold on the given rows and report metrics on the same rows.

    With a cap the threshold is raised to the lowest probability actually selected.
    """
    table = sweep(df, candidate_thresholds(df, p=p, decimals=decimals), cap, p=p, y=y, ts=ts, tie=tie, payoff=payoff)
    if mode == "hybrid":
        bound = max_recall(df, cap, y=y, ts=ts) if cap else None
        best = pick_hybrid(table, min_precision, min_recall, min_trades, recall_bound=bound)
    elif mode == "ev":
        best = pick_ev(table, min_trades)
    elif mode == "f1":
        best = pick_f1(table, min_precision, min_trades)
    else:
        raise ValueError(f"unknown mode: {mode}")
    result = evaluate_fixed(df, best, cap, p=p, y=y, ts=ts, tie=tie)
    if cap:
        result = result.withColumn("threshold", F.coalesce("lowest_selected", "threshold"))
    return result


def probability_profile(
    df: DataFrame, threshold: float = 0.5, *, p: str = "probability", percents: tuple[int, ...] = (0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100)
) -> DataFrame:
    """Long table (statistic, value): count, percentiles, shares above the threshold and above one half."""
    q = exact_quantiles(df, p, [x / 100 for x in percents]).select(
        F.concat(F.lit("p"), F.round(F.col("prob") * 100).cast("int").cast("string")).alias("statistic"),
        F.col("q").alias("value"),
    )
    one = df.agg(
        F.count(p).cast("double").alias("count"),
        F.avg((F.col(p) >= threshold).cast("double")).alias("share_ge_threshold"),
        F.avg((F.col(p) >= 0.5).cast("double")).alias("share_ge_half"),
        F.avg(p).alias("mean"),
    )
    names = ("count", "share_ge_threshold", "share_ge_half", "mean")
    shares = one.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("value")) for c in names])).alias("_s")
    ).select("_s.*")
    return q.unionByName(shares)


def top_probabilities(df: DataFrame, k: int = 20, *, p: str = "probability", ts: str = "ts") -> DataFrame:
    return df.orderBy(F.col(p).desc(), F.col(ts)).limit(k)


def reason_counts(df: DataFrame, reasons: dict[str, Column], passed: str = "signal") -> DataFrame:
    """Rows per first failing filter, in the given order; rows that fail none are ``passed``."""
    reason = None
    for name, failed in reasons.items():
        reason = F.when(failed, name) if reason is None else reason.when(failed, name)
    return df.groupBy(reason.otherwise(passed).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
