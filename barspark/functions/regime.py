"""Market-regime expressions over ATR, ADX, price and the long mean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier names by volatility, highest first, with their descriptions.
TIERS = (
    ("TIER1_HIGH_ATR", "HIGH_VOL_TREND"),
    ("TIER2_MOD_ATR", "MOD_VOL_TREND"),
    ("TIER3_LOW_ATR", "LOW_VOL"),
    ("TIER4_VERY_LOW_ATR", "NO_VOL"),
)


@dataclass(frozen=True)
class RegimeRules:
    """Fixed default values of the regime gate."""

    high_atr: float = 18.0
    mod_atr: float = 12.0
    low_atr: float = 8.0
    min_atr: float = 8.0
    min_adx: float = 8.0
    min_dist: float = 0.0
    threshold_high: float = 0.35
    threshold_mod: float = 0.50
    threshold_low: float = 0.65
    adaptive: bool = True


DEFAULT_RULES = RegimeRules()


def _valid(atr: Column, adx: Column) -> Column:
    return F.coalesce((atr > 0) & (adx >= 0) & ~F.isnan(atr) & ~F.isnan(adx), F.lit(False))


def regime_tier(atr: Column, adx: Column, rules: RegimeRules = DEFAULT_RULES) -> Column:
    return (
        F.when(~_valid(atr, adx), TIERS[3][0])
        .when(atr >= rules.high_atr, TIERS[0][0])
        .when(atr >= rules.mod_atr, TIERS[1][0])
        .when(atr >= rules.low_atr, TIERS[2][0])
        .otherwise(TIERS[3][0])
    )


def classify_regime(atr: Column, adx: Column, price: Column, sma: Column, rules: RegimeRules = DEFAULT_RULES) -> Column:
    """Struct of tier, distance to the long mean, up-trend flag and description."""
    tier = regime_tier(atr, adx, rules)
    dist = price - sma
    up = _valid(atr, adx) & F.coalesce((dist > 0) & (adx > rules.min_adx), F.lit(False))
    words = F.lit("Invalid input")
    for name, text in TIERS:
        words = F.when(_valid(atr, adx) & (tier == name), text).otherwise(words)
    return F.struct(tier.alias("regime"), dist.alias("dist"), up.alias("in_uptrend"), words.alias("description"))


def trade_allowed(atr: Column, adx: Column, price: Column, sma: Column, rules: RegimeRules = DEFAULT_RULES) -> Column:
    ok = (atr >= rules.min_atr) & (adx >= rules.min_adx) & (price - sma >= rules.min_dist)
    return F.coalesce(ok, F.lit(False))


def trade_reason(atr: Column, adx: Column, price: Column, sma: Column, rules: RegimeRules = DEFAULT_RULES) -> Column:
    """Three readable parts joined by ' + '."""
    dist = price - sma

    def num(c: Column) -> Column:
        return F.format_string("%.1f", F.round(c, 6))

    parts = (
        F.when(atr < rules.min_atr, F.concat(F.lit("Low ATR ("), num(atr), F.lit(f" < {rules.min_atr})"))).otherwise(
            F.concat(F.lit("ATR OK ("), num(atr), F.lit(")"))
        ),
        F.when(
            adx < rules.min_adx, F.concat(F.lit("No trend (ADX "), num(adx), F.lit(f" < {rules.min_adx})"))
        ).otherwise(F.concat(F.lit("Trend OK (ADX "), num(adx), F.lit(")"))),
        F.when(
            dist < rules.min_dist, F.concat(F.lit("Not uptrend (dist "), num(dist), F.lit(f" < {rules.min_dist})"))
        ).otherwise(F.concat(F.lit("Uptrend OK (dist "), num(dist), F.lit(")"))),
    )
    return F.concat_ws(" + ", *parts)


def should_trade(atr: Column, adx: Column, price: Column, sma: Column, rules: RegimeRules = DEFAULT_RULES) -> Column:
    """Struct (allowed, regime, reason)."""
    return F.struct(
        trade_allowed(atr, adx, price, sma, rules).alias("allowed"),
        regime_tier(atr, adx, rules).alias("regime"),
        trade_reason(atr, adx, price, sma, rules).alias("reason"),
    )


def adaptive_threshold(atr: Column, rules: RegimeRules = DEFAULT_RULES) -> Column:
    if not rules.adaptive:
        return F.lit(0.5)
    return (
        F.when(atr >= rules.high_atr, rules.threshold_high)
        .when(atr >= rules.mod_atr, rules.threshold_mod)
        .otherwise(rules.threshold_low)
    )
