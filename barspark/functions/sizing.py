"""Position size, pip value and small trade expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Instrument -> units in one lot.
LOT_UNITS = {"XAUUSD": 100.0}
# Capital per Kelly unit and reference volatility.
KELLY_CAPITAL_UNIT = 10_000.0
REFERENCE_VOLATILITY = 0.01
METHODS = ("fixed", "risk_based", "kelly", "volatility_based")


@dataclass(frozen=True)
class SizingRules:
    fixed_size: float = 0.01
    risk_per_trade: float = 0.01
    kelly_fraction: float = 0.25
    min_size: float = 0.01
    max_size: float = 1.0


def position_size(
    method: str | Column,
    *,
    capital: Column,
    stop_pips: Column | None = None,
    pip_value: Column | None = None,
    win_rate: Column | None = None,
    avg_win: Column | None = None,
    avg_loss: Column | None = None,
    volatility: Column | None = None,
    rules: SizingRules | None = None,
) -> Column:
    """Lots by method, bounded to [min_size, max_size]; null where an input the method needs is unusable."""
    rules = rules or SizingRules()
    if isinstance(method, str):
        if method not in METHODS:
            raise ValueError(f"unknown position sizing method: {method}")
        method = F.lit(method)
    none = F.lit(None).cast("double")
    pip = pip_value if pip_value is not None else F.lit(1.0)
    fixed = F.lit(rules.fixed_size)
    risk = none
    if stop_pips is not None:
        risk = F.when(stop_pips > 0, capital * rules.risk_per_trade / (stop_pips * pip))
    kelly = none
    if win_rate is not None and avg_win is not None and avg_loss is not None:
        edge = (win_rate - F.try_divide((1 - win_rate) * avg_loss, avg_win)) * rules.kelly_fraction
        usable = win_rate.between(0, 1) & (avg_loss > 0)
        kelly = F.when(
            usable, F.when(edge <= 0, F.lit(rules.min_size)).otherwise(edge * capital / KELLY_CAPITAL_UNIT)
        )
    vol = none
    if volatility is not None:
        vol = F.when(volatility > 0, rules.fixed_size * REFERENCE_VOLATILITY / volatility)
    size = (
        F.when(method == "fixed", fixed)
        .when(method == "risk_based", risk)
        .when(method == "kelly", kelly)
        .when(method == "volatility_based", vol)
    )
    bounded = F.greatest(F.lit(rules.min_size), F.least(size, F.lit(rules.max_size)))
    return F.when(size.isNotNull() & (capital > 0), bounded)


def _units(instrument: str) -> float:
    try:
        return LOT_UNITS[instrument.upper()]
    except KeyError:
        raise ValueError(f"unsupported instrument: {instrument}") from None


def pip_value(lots: Column, instrument: str = "XAUUSD") -> Column:
    return lots * _units(instrument)


def lots_to_units(lots: Column, instrument: str = "XAUUSD") -> Column:
    return lots * _units(instrument)


def transaction_cost(spread: float = 0.5, slippage: float = 0.3, commission: float = 0.0) -> float:
    return spread + slippage + commission


def levels(price: Column, atr: Column, sl: float = 1.0, tp: float = 2.0) -> tuple[Column, Column, Column]:
    """Stop, target and reward/risk from multiples of ATR."""
    return price - sl * atr, price + tp * atr, F.lit(tp / sl)


def confidence(p: Column) -> Column:
    return (
        F.when((p >= 0.7) | (p <= 0.3), "high").when((p >= 0.55) | (p <= 0.45), "medium").otherwise("low")
    )


def signal_type(prediction: Column, p: Column, threshold: Column) -> Column:
    return F.when(prediction == 1, F.when(p >= threshold, "BUY").otherwise("BUY_LOW_CONFIDENCE")).otherwise("SELL")
