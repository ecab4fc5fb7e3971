"""Descriptive analytics over features, predictions and trades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.indicators import range_atr
from barspark.plans.chunks import with_row_index
from barspark.plans.scan import exact_quantiles

# Bands of absolute correlation, strongest first.
BANDS = {
    "short": (("STRONG", 0.05), ("WEAK", 0.01)),
    "long": (("STRONG", 0.1), ("MEDIUM", 0.05), ("WEAK", 0.01)),
}
# Fixed value: ounces per lot in the break-even table.
OUNCES = 31.1035


def _long(df: DataFrame, features: Sequence[str], facts: Mapping[str, object]) -> DataFrame:
    """One aggregate over all features, then one row per feature."""
    wide = df.agg(
        *[F.struct(F.lit(f).alias("feature"), *[fn(f).alias(n) for n, fn in facts.items()]).alias(f"_x{i}") for i, f in enumerate(features)]
    )
    return wide.select(F.explode(F.array(*[f"_x{i}" for i in range(len(features))])).alias("_x")).select("_x.*")


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate that is null, not an error, for a constant column."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def strength(abs_corr: Column, bands: str = "short") -> Column:
    out = None
    for name, bound in BANDS[bands]:
        out = F.when(abs_corr > bound, name) if out is None else out.when(abs_corr > bound, name)
    return out.otherwise("NONE")


def corr_rank(df: DataFrame, features: Sequence[str], label: str = "label", bands: str = "short") -> DataFrame:
    """Pearson correlation of every feature with the label, its size and band, strongest first."""
    y = F.col(label).cast("double")
    out = _long(df, features, {"corr": lambda f: pearson(F.col(f).cast("double"), y)})
    return (
        out.withColumn("abs_corr", F.abs("corr"))
        .withColumn("strength", strength(F.col("abs_corr"), bands))
        .orderBy(F.col("abs_corr").desc_nulls_last(), "feature")
    )


def conditional_means(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Mean given label 1 and 0, their absolute difference, deviation, variance and share of zeros."""
    y = F.col(label)

    def given(v: int):
        return lambda f: F.avg(F.when(y == v, F.col(f).cast("double")))

    out = _long(
        df,
        features,
        {
            "mean_pos": given(1),
            "mean_neg": given(0),
            "std": lambda f: F.stddev_samp(F.col(f).cast("double")),
            "variance": lambda f: F.var_samp(F.col(f).cast("double")),
            "zero_pct": lambda f: 100.0 * F.avg((F.col(f) == 0).cast("double")),
        },
    )
    return out.withColumn("signal_diff", F.abs(F.col("mean_pos") - F.col("mean_neg")))


def family_rollup(corr_df: DataFrame, family_of: Mapping[str, str]) -> DataFrame:
    """Strongest, mean and weakest correlation per feature family (the map is a literal)."""
    pairs = F.create_map(*[F.lit(x) for kv in family_of.items() for x in kv])
    return (
        corr_df.withColumn("family", F.element_at(pairs, F.col("feature")))
        .where(F.col("family").isNotNull())
        .groupBy("family")
        .agg(
            F.max("abs_corr").alias("max_corr"),
            F.avg("abs_corr").alias("mean_corr"),
            F.min("abs_corr").alias("min_corr"),
            F.count(F.lit(1)).alias("n_features"),
        )
    )


def top_bottom(df: DataFrame, col: str, k_top: int = 15, k_bottom: int = 10, tie: str = "feature") -> DataFrame:
    top = df.orderBy(F.col(col).desc_nulls_last(), tie).limit(k_top).withColumn("side", F.lit("top"))
    low = df.orderBy(F.col(col).asc_nulls_last(), tie).limit(k_bottom).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def problem_features(stats: DataFrame, low_var: float = 0.001, zeros: float = 50.0) -> DataFrame:
    return stats.where((F.col("variance") < low_var) | (F.col("zero_pct") > zeros))


def _melt(df: DataFrame, features: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(F.explode(pairs).alias("_p")).select("_p.*")


def drift(train: DataFrame, current: DataFrame, features: Sequence[str], bound: float = 3.0) -> DataFrame:
    """Current mean, deviation and percentiles against the training median and inter-quartile range."""
    ref = (
        exact_quantiles(_melt(train, features), "value", [0.25, 0.5, 0.75], keys=["feature"])
        .groupBy("feature")
        .pivot("prob", [0.25, 0.5, 0.75])
        .agg(F.first("q"))
        .select("feature", F.col("`0.5`").alias("ref_center"), (F.col("`0.75`") - F.col("`0.25`")).alias("ref_scale"))
    )
    long = _melt(current, features)
    stats = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    marks = (
        exact_quantiles(long, "value", [0.01, 0.5, 0.99], keys=["feature"])
        .groupBy("feature")
        .pivot("prob", [0.01, 0.5, 0.99])
        .agg(F.first("q"))
        .select("feature", F.col("`0.01`").alias("p1"), F.col("`0.5`").alias("p50"), F.col("`0.99`").alias("p99"))
    )
    z = F.try_divide(F.col("mean") - F.col("ref_center"), F.col("ref_scale"))
    return (
        stats.join(marks, "feature")
        .join(ref, "feature")
        .withColumn("z_shift", z)
        .withColumn("drifted", F.coalesce(F.abs("z_shift") > bound, F.lit(False)))
    )


def outcome_by_probability(signals: DataFrame, high: float = 0.7) -> DataFrame:
    """Count, mean and median probability per outcome, and losses above the high mark."""
    stats = signals.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("probability").alias("mean_p"),
        F.count_if((F.col("outcome") == "Loss") & (F.col("probability") > high)).alias("high_p_losses"),
    )
    med = exact_quantiles(signals, "probability", [0.5], keys=["outcome"]).select("outcome", F.col("q").alias("median_p"))
    return stats.join(med, "outcome")


def outcome_by_atr(signals: DataFrame, atr: str = "atr") -> DataFrame:
    return signals.groupBy("outcome").agg(F.avg(atr).alias("mean_atr"), F.count(atr).alias("n"))


def hour_histogram(signals: DataFrame, k: int = 5, ts: str = "ts") -> DataFrame:
    """The k hours with the most rows."""
    return (
        signals.groupBy(F.hour(ts).alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "hour")
        .limit(k)
    )


def run_totals(trades: DataFrame) -> DataFrame:
    return trades.agg(
        F.count(F.lit(1)).alias("n_trades"),
        (100.0 * F.avg(F.col("is_win").cast("double"))).alias("win_pct"),
        F.sum("pnl").alias("total_pnl"),
        F.avg("gross_pnl").alias("mean_gross"),
    )


def compare_runs(
    old: DataFrame,
    new: DataFrame,
    cols: Sequence[str] = ("entry_price", "position_size", "probability"),
    *,
    ts: str = "ts",
    tie: Sequence[str] = (),
    chunk_rows: int | None = None,
) -> DataFrame:
    """Trade n of one run beside trade n of the other, with null-safe equality per column."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        one = df.withColumn("_g", F.lit(1))
        placed = with_row_index(one, keys=("_g",), ts=ts, order=(ts, *tie), index="n_trade", total="_n")
        return placed.select("n_trade", *[F.col(c).alias(f"{tag}_{c}") for c in (ts, *cols, "pnl", "is_win")])

    both = side(old, "old").join(side(new, "new"), "n_trade", "full_outer")
    same = {f"same_{c}": F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in (ts, *cols)}
    return both.withColumns({**same, "pnl_diff": F.col("new_pnl") - F.col("old_pnl")})


def comparison_summary(compared: DataFrame, ts: str = "ts", cols: Sequence[str] = ("entry_price", "position_size", "probability")) -> DataFrame:
    """Whether two runs have the same entries, prices, sizes and probabilities."""
    return compared.agg(
        F.count(f"old_{ts}").alias("n_old"),
        F.count(f"new_{ts}").alias("n_new"),
        *[F.bool_and(f"same_{c}").alias(f"all_same_{c}") for c in (ts, *cols)],
        F.sum("pnl_diff").alias("pnl_diff"),
    )


def trade_summary(trades: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, shares, mean duration, P&L and return on the value invested."""
    roi = F.try_divide(F.col("pnl"), F.col("position_size") * F.col("entry_price"))
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if("is_win").alias("n_wins"),
        F.count_if(~F.col("is_win")).alias("n_losses"),
        (100.0 * F.avg(F.col("is_win").cast("double"))).alias("win_pct"),
        F.avg("duration_minutes").alias("mean_duration"),
        F.sum("pnl").alias("total_pnl"),
        F.avg("pnl").alias("mean_pnl"),
        F.avg(F.col("position_size") * F.col("entry_price")).alias("mean_invested"),
        (100.0 * F.avg(roi)).alias("mean_roi_pct"),
    )


def recovered_levels(trades: DataFrame, sl: float = 1.0, tp: float = 1.8) -> DataFrame:
    """ATR, stop and target implied by the gross result of a target hit."""
    atr = F.try_divide(F.col("gross_pnl"), F.col("position_size") * tp)
    return trades.withColumn("implied_atr", atr).withColumns(
        {
            "sl_price": F.col("entry_price") - sl * F.col("implied_atr"),
            "tp_price": F.col("entry_price") + tp * F.col("implied_atr"),
            "rr": F.lit(tp / sl),
        }
    )


def break_even(
    bars: DataFrame,
    sl: float = 0.1,
    tp: float = 0.2,
    size: float = 0.01,
    cost: float = 0.8,
    win_rate: float | None = None,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Range statistics, net value of target and stop, break-even win rate and expected result per key."""
    rng = range_atr(bars, 14, out="_atr", keys=keys, ts=ts, chunk_rows=chunk_rows)
    stats = rng.groupBy(*keys).agg(
        F.avg("_atr").alias("atr_mean"),
        F.stddev_samp("_atr").alias("atr_std"),
        F.min("_atr").alias("atr_min"),
        F.max("_atr").alias("atr_max"),
    )
    med = exact_quantiles(rng, "_atr", [0.5], keys=keys).select(*keys, F.col("q").alias("atr_median"))
    units = size * OUNCES
    net_tp = F.col("atr_mean") * tp * units - cost
    net_sl = -(F.col("atr_mean") * sl * units + cost)
    out = stats.join(med, list(keys)).withColumns({"net_tp": net_tp, "net_sl": net_sl})
    need = F.when(F.col("net_tp") > 0, F.abs("net_sl") / (F.col("net_tp") + F.abs("net_sl")))
    out = out.withColumns(
        {
            "break_even_win_rate": need,
            "min_size": F.try_divide(F.lit(cost), F.col("atr_mean") * tp * OUNCES),
            "min_tp_multiplier": F.try_divide(F.lit(cost), F.col("atr_mean") * units),
        }
    )
    if win_rate is not None:
        expected = win_rate * F.col("net_tp") + (1 - win_rate) * F.col("net_sl")
        out = out.withColumn("expected_pnl", F.when(F.col("net_tp") > 0, expected))
    return out
