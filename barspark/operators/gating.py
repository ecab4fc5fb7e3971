"""Regime gating of rows and predictions, with reports and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.regime import DEFAULT_RULES, TIERS, RegimeRules, adaptive_threshold, regime_tier, trade_allowed

# ATR and ADX assumed where a row has none.
ROW_ADX, GATE_ATR, GATE_ADX = 15.0, 10.0, 10.0
# Alert bounds on the suppression rate and on the share of the top tier.
ALERTS = {
    "suppression_rate_too_high": ("suppression_rate", ">", 0.50),
    "suppression_rate_too_low": ("suppression_rate", "<", 0.20),
    "high_tier1_share": ("tier1_share", ">", 0.60),
    "low_tier1_share": ("tier1_share", "<", 0.10),
}


def _inputs(df: DataFrame, atr: str, adx: str, price: str, sma: str, default_atr: float | None, default_adx: float) -> list[Column]:
    if price not in df.columns:
        raise ValueError(f"regime gating needs a price column, got none named {price}")
    a = F.col(atr) if default_atr is None else F.coalesce(F.col(atr), F.lit(default_atr))
    d = F.coalesce(F.col(adx), F.lit(default_adx)) if adx in df.columns else F.lit(default_adx)
    return [a, d, F.col(price), F.col(sma)]


def with_regime(
    df: DataFrame, *, atr="atr_m5", adx="adx", price="close", sma="sma_200", rules: RegimeRules = DEFAULT_RULES
) -> DataFrame:
    """Add ``regime`` and ``allowed``."""
    cols = _inputs(df, atr, adx, price, sma, None, ROW_ADX)
    return df.withColumns({"regime": regime_tier(cols[0], cols[1], rules), "allowed": trade_allowed(*cols, rules)})


def filter_by_regime(
    df: DataFrame, *, enabled: bool = True, atr="atr_m5", adx="adx", price="close", sma="sma_200", rules: RegimeRules = DEFAULT_RULES
) -> DataFrame:
    """Rows whose regime allows trading; everything when the filter is off."""
    if not enabled:
        return df
    return df.where(trade_allowed(*_inputs(df, atr, adx, price, sma, None, ROW_ADX), rules))


def regime_counts(df: DataFrame, **names) -> DataFrame:
    """Rows and kept rows per tier."""
    return with_regime(df, **names).groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("allowed").alias("kept")
    )


def gate_predictions(
    df: DataFrame,
    *,
    p: str = "probability",
    enabled: bool = True,
    threshold: float = 0.5,
    atr="atr_m5",
    adx="adx",
    price="close",
    sma="sma_200",
    rules: RegimeRules = DEFAULT_RULES,
    out: str = "gated",
) -> DataFrame:
    """Add ``gated``: 0 outside allowed regimes, else p at or above the tier's threshold."""
    if not enabled:
        return df.withColumn(out, (F.col(p) >= threshold).cast("int"))
    cols = _inputs(df, atr, adx, price, sma, GATE_ATR, GATE_ADX)
    allowed = trade_allowed(*cols, rules)
    hit = F.col(p) >= adaptive_threshold(cols[0], rules)
    return df.withColumns({out: (allowed & hit).cast("int"), "regime": regime_tier(cols[0], cols[1], rules)})


def suppression_report(df: DataFrame, *, signal: str = "prediction", gated: str = "gated", p: str = "probability") -> DataFrame:
    """One row: signals generated, suppressed, executed, suppression rate, and share and confidence per tier."""
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(signal) == 1).alias("generated"),
        F.count_if((F.col(signal) == 1) & (F.col(gated) == 0)).alias("suppressed"),
        F.count_if(F.col(gated) == 1).alias("executed"),
    ]
    for i, (name, _) in enumerate(TIERS, 1):
        mine = F.col("regime") == name
        aggs.append(F.avg(mine.cast("double")).alias(f"tier{i}_share"))
        aggs.append(F.avg(F.when(mine, F.col(p))).alias(f"tier{i}_confidence"))
    return df.agg(*aggs).withColumn(
        "suppression_rate", F.col("suppressed") / F.greatest(F.col("generated"), F.lit(1))
    )


def regime_alerts(report: DataFrame) -> DataFrame:
    """One row per alert rule that fires on a suppression report."""
    fired = []
    for name, (col, op, bound) in ALERTS.items():
        hit = F.col(col) > bound if op == ">" else F.col(col) < bound
        fired.append(F.when(hit, F.struct(F.lit(name).alias("alert"), F.col(col).alias("value"), F.lit(bound).alias("bound"))))
    return report.select(F.explode(F.array_compact(F.array(*fired))).alias("_a")).select("_a.*")


def compare_gating(
    df: DataFrame, *, baseline: str = "prediction", gated: str = "gated", y: str = "label", group: tuple[str, ...] = ()
) -> DataFrame:
    """Metrics of the ungated and the gated decisions in one pass, with absolute and relative change."""

    def side(col: str, tag: str) -> list[Column]:
        on = F.col(col) == 1
        return [
            F.count_if(on).alias(f"trades_{tag}"),
            F.count_if(on & (F.col(y) == 1)).alias(f"wins_{tag}"),
        ]

    facts = df.groupBy(*group).agg(*side(baseline, "base"), *side(gated, "gated"), F.count_if(F.col(y) == 1).alias("positives"))
    rates = {}
    for tag in ("base", "gated"):
        rates[f"precision_{tag}"] = F.coalesce(F.try_divide(F.col(f"wins_{tag}"), F.col(f"trades_{tag}")), F.lit(0.0))
        rates[f"recall_{tag}"] = F.coalesce(F.try_divide(F.col(f"wins_{tag}"), F.col("positives")), F.lit(0.0))
    out = facts.withColumns(rates)
    change = F.col("precision_gated") - F.col("precision_base")
    return out.withColumns(
        {
            "trades_removed": F.col("trades_base") - F.col("trades_gated"),
            "removed_pct": F.coalesce(
                F.try_divide(100.0 * (F.col("trades_base") - F.col("trades_gated")), F.col("trades_base")), F.lit(0.0)
            ),
            "precision_change": change,
            "precision_change_pct": F.try_divide(100.0 * change, F.col("precision_base")),
        }
    )
