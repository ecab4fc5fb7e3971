"""Data quality: validation, de-duplication, cleaning, profiles and issue rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.study import Study
from barspark.operators.bars import OHLCV
from barspark.plans.scan import running


class Validated(NamedTuple):
    clean: DataFrame
    rejects: DataFrame
    report: DataFrame


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _count(cond: Column, name: str) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).alias(name)


def validate_bars(bars: DataFrame, *, rules: bool = True) -> Validated:
    """Coerce prices and volume to numbers and split off rows that cannot be used.

    The one-row report counts unusable values and rule breaks (price <= 0, volume < 0, high < low). Without ``rules``
    such breaks are counted only, and a row is rejected for its numbers alone.
    """
    missing = [c for c in OHLCV if c not in bars.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    typed = bars.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in OHLCV})
    bad = F.lit(False)
    for c in OHLCV:
        bad = bad | ~_finite(F.col(c))
    reason = F.when(bad, "not a number")
    if rules:
        for c in OHLCV[:4]:
            reason = reason.when(F.col(c) <= 0, f"{c} not positive")
        reason = reason.when(F.col("volume") < 0, "negative volume").when(F.col("high") < F.col("low"), "high below low")
    judged = typed.withColumn("reject_reason", reason)
    report = judged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        _count(bad, "n_not_numeric"),
        _count(~bad & (F.least(*OHLCV[:4]) <= 0), "n_nonpositive_price"),
        _count(~bad & (F.col("volume") < 0), "n_negative_volume"),
        _count(~bad & (F.col("high") < F.col("low")), "n_high_below_low"),
    )
    return Validated(
        judged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        judged.where(F.col("reject_reason").isNotNull()),
        report,
    )


def require_valid(report: DataFrame, *, rules: bool = True) -> None:
    """Raise on rule breaks, as a strict load does (unparsable rows are only dropped)."""
    row = report.first()
    for name in ("n_nonpositive_price", "n_negative_volume", "n_high_below_low"):
        if rules and row[name]:
            raise ValueError(f"bar data breaks a rule: {name} = {row[name]}")
    if row["n_rows"] == row["n_not_numeric"]:
        raise ValueError("no usable bars left after validation")


def validate_window(bars: DataFrame, n: int | None = None, at_least: int | None = None) -> DataFrame:
    """One-row verdict on an inference window: size, numbers, positive prices, high >= low."""
    bad = F.lit(False)
    for c in OHLCV:
        bad = bad | ~_finite(F.col(c).cast("double"))
    size = F.count(F.lit(1))
    size_ok = F.lit(True)
    if n is not None:
        size_ok = size == n
    if at_least is not None:
        size_ok = size_ok & (size >= at_least)
    facts = bars.agg(
        size.alias("n_rows"),
        size_ok.alias("size_ok"),
        _count(bad, "n_not_finite"),
        _count(F.least(*OHLCV[:4]) <= 0, "n_nonpositive_price"),
        _count(F.col("high") < F.col("low"), "n_high_below_low"),
    )
    ok = (
        F.col("size_ok")
        & (F.col("n_not_finite") == 0)
        & (F.col("n_nonpositive_price") == 0)
        & (F.col("n_high_below_low") == 0)
    )
    return facts.withColumn("ok", ok)


def dedup_bars(
    bars: DataFrame, keep: str = "first", *, keys: Sequence[str] = ("symbol", "ts"), order: Sequence[str] = ("line",)
) -> DataFrame:
    """One row per (symbol, ts): the first or the last in ``order``.

    A min/max over a struct merges map-side, so a timestamp repeated many times is not sorted in one task.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"unknown keep: {keep}")
    rest = [c for c in bars.columns if c not in keys]
    pick = F.min if keep == "first" else F.max
    whole = F.struct(*order, *[c for c in rest if c not in order])
    return bars.groupBy(*keys).agg(pick(whole).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def with_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where every column has a value.

    Written as separate IS NOT NULL terms: the single many-column term of ``dropna`` makes the
    optimizer's constraint set double with every later renaming of one of the columns.
    """
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in cols]))


def clean_features(
    features: DataFrame,
    cols: Sequence[str],
    mode: str = "zero",
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Infinities to null, carry the last value forward, then fill 0 (``zero``) or drop what is left (``drop``)."""
    if mode not in ("zero", "drop"):
        raise ValueError(f"unknown mode: {mode}")
    cols = list(cols)
    real = features.withColumns({c: F.when(_finite(F.col(c).cast("double")), F.col(c)) for c in cols})
    filled = running(real, {f"_f_{c}": ("last", c) for c in cols}, keys=keys, ts=ts)
    out = filled.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])
    return out.fillna(0, subset=cols) if mode == "zero" else with_values(out, cols)


def profile(df: DataFrame, cols: Sequence[str], *, zero_var: float = 1e-10, low_var: float = 1e-3) -> DataFrame:
    """Long table per column: nulls, infinities, min, max, variance and variance flags."""
    cols = list(cols)
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        ok = F.when(_finite(v), v)
        aggs.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.count_if(v.isNull() | F.isnan(v)).alias("n_null"),
                F.count_if(F.abs(v) == float("inf")).alias("n_inf"),
                F.min(ok).alias("min"),
                F.max(ok).alias("max"),
                F.var_samp(ok).alias("variance"),
            ).alias(c)
        )
    wide = df.agg(*aggs)
    return (
        wide.select(F.explode(F.array(*cols)).alias("_p"))
        .select("_p.*")
        .withColumn("zero_variance", F.coalesce(F.col("variance") < zero_var, F.lit(True)))
        .withColumn("low_variance", F.coalesce((F.col("variance") >= zero_var) & (F.col("variance") < low_var), F.lit(False)))
    )


def label_by_month(rows: DataFrame, label: str = "label", ts: str = "ts") -> DataFrame:
    return (
        rows.groupBy(F.date_trunc("month", F.col(ts)).cast("timestamp_ntz").alias("month"))
        .agg(F.count(label).alias("total"), F.sum(label).alias("positive"))
        .withColumn("positive_pct", F.try_divide(100.0 * F.col("positive"), F.col("total")))
    )


def quality_issues(
    profile_df: DataFrame, rows: DataFrame, features: Sequence[str], label: str = "label"
) -> DataFrame:
    """Rules over the profile, the label share and the strongest correlation; one row per issue."""
    from barspark.operators.analytics import corr_rank

    facts = profile_df.agg(
        F.sum(F.col("zero_variance").cast("long")).alias("zero_var"), F.sum("n_null").alias("nulls")
    )
    share = rows.agg((100.0 * F.avg(label)).alias("pos"))
    strongest = corr_rank(rows, features, label).agg(F.max("abs_corr").alias("corr"))
    one = facts.withColumn("pos", share.scalar()).withColumn("corr", strongest.scalar())
    rules = F.array_compact(
        F.array(
            F.when(F.col("zero_var") > 0, F.format_string("%d features have zero variance", "zero_var")),
            F.when(F.col("corr") < 0.01, F.format_string("strongest correlation is %.6f", "corr")),
            F.when((F.col("pos") < 20) | (F.col("pos") > 80), F.format_string("class imbalance: %.1f%% positive", "pos")),
            F.when(F.col("nulls") > 0, F.format_string("%d missing values", "nulls")),
        )
    )
    return one.select(F.explode(rules).alias("issue"))


def validate_predictions(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """One-row verdict on backtest input."""
    for frame, need in ((predictions, ("probability", "prediction")), (bars, OHLCV)):
        missing = [c for c in need if c not in frame.columns]
        if missing:
            raise ValueError(f"missing required columns: {', '.join(missing)}")
    p, y = F.col("probability"), F.col("prediction")
    left = predictions.agg(
        F.count(F.lit(1)).alias("n_predictions"),
        _count(~_finite(p) | (p < 0) | (p > 1), "n_bad_probability"),
        _count(y.isNull() | ~y.isin(0, 1), "n_bad_prediction"),
    )
    bad = F.lit(False)
    for c in OHLCV[:4]:
        bad = bad | ~_finite(F.col(c).cast("double")) | (F.col(c) <= 0)
    prices = bars.agg(F.struct(F.count(F.lit(1)).alias("n"), _count(bad, "bad")).alias("s"))
    out = left.withColumn("_s", prices.scalar()).select(
        "n_predictions",
        "n_bad_probability",
        "n_bad_prediction",
        F.col("_s.n").alias("n_bars"),
        F.col("_s.bad").alias("n_bad_price"),
    )
    ok = (F.col("n_predictions") > 0) & (F.col("n_bars") > 0)
    for c in ("n_bad_probability", "n_bad_prediction", "n_bad_price"):
        ok = ok & (F.col(c) == 0)
    return out.withColumn("ok", ok)


def class_balance(rows: DataFrame, tol: float = 10.0, *, split: str = "split", label: str = "label") -> DataFrame:
    """Positive share per split with the largest pairwise gap in percentage points."""
    shares = rows.groupBy(split).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"),
        (100.0 * F.avg(label)).alias("pos_pct"),
    )
    gap = shares.agg((F.max("pos_pct") - F.min("pos_pct")).alias("g"))
    return shares.withColumn("max_gap", gap.scalar()).withColumn("stable", F.col("max_gap") <= tol)


def extreme_moves(
    bars: DataFrame, pct: float = 10.0, *, keys: Sequence[str] = ("symbol",), ts: str = "ts", chunk_rows: int | None = None
) -> DataFrame:
    """Per key: jumps above ``pct`` percent between closes, non-positive prices, negative volumes."""
    study = Study()
    study.out("_move", study.roc("close", 1))
    moved = study.apply(bars, keys=keys, ts=ts, chunk_rows=chunk_rows)
    return moved.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        _count(F.abs("_move") > pct / 100.0, "n_extreme"),
        _count(F.least(*OHLCV[:4]) <= 0, "n_nonpositive_price"),
        _count(F.col("volume") < 0, "n_negative_volume"),
    )


def newest_rows(df: DataFrame, n: int, ts: str = "ts", *tie: str) -> DataFrame:
    """The newest n rows overall.

    Rows per day say on which day the n-th row lies. Later days are kept whole and only that day is ranked,
    so no task gets more than a day of rows, whatever n is. Rows without a time are the oldest.
    """
    day = F.coalesce(F.to_date(ts), F.lit("0001-01-01").cast("date"))
    counts = df.groupBy(day.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    newer = Window.orderBy(F.col("_d").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    room = counts.select(F.col("_d").alias("_day"), "_n", (n - F.coalesce(F.sum("_n").over(newer), F.lit(0))).alias("_room")).where("_room > 0")
    rows = df.withColumn("_d", day).join(room, F.col("_d") == F.col("_day"))
    part = F.when(F.col("_n") > F.col("_room"), -1).otherwise(F.pmod(F.xxhash64(ts), F.lit(256)))
    rank = F.row_number().over(Window.partitionBy("_d", "_part").orderBy(F.col(ts).desc(), *[F.col(c).desc() for c in tie]))
    ranked = rows.withColumn("_part", part).withColumn("_rn", rank)
    return ranked.where(F.col("_rn") <= F.col("_room")).drop("_d", "_day", "_n", "_room", "_part", "_rn")


