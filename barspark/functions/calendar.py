"""Time-of-day and calendar predicates and encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Session name -> (first hour, hour after the last).
SESSIONS = {
    "london": (8, 16),
    "ny": (13, 22),
    "asian": (0, 9),
    "london_ny": (8, 22),
}
# Weekday tokens, Monday first.
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def in_session(ts: str | Column, name: str, start: int | None = None, end: int | None = None) -> Column:
    """Session predicate; ``custom`` takes hours and may wrap midnight. Nothing matching keeps nothing."""
    col = F.col(ts) if isinstance(ts, str) else ts
    if name == "all":
        return F.lit(True)
    if name == "custom":
        if start is None or end is None:
            raise ValueError("a custom session needs start and end hours")
    elif name in SESSIONS:
        start, end = SESSIONS[name]
    else:
        raise ValueError(f"unknown session: {name}")
    hour = F.hour(col)
    if start < end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def on_days(ts: str | Column, tokens: Sequence[str]) -> Column:
    """True on the listed weekdays (``Mon`` ...) or ISO dates."""
    col = F.col(ts) if isinstance(ts, str) else ts
    names = [t.strip().lower()[:3] for t in tokens if t.strip()[:1].isalpha()]
    unknown = [n for n in names if n not in WEEKDAYS]
    if unknown:
        raise ValueError(f"unknown weekday: {unknown[0]}")
    dates = [t.strip() for t in tokens if t.strip()[:1].isdigit()]
    hit = F.lit(False)
    if names:
        hit = hit | F.weekday(col).isin([WEEKDAYS.index(n) for n in names])
    if dates:
        hit = hit | F.to_date(col).isin([F.lit(d).cast("date") for d in dates])
    return hit


def closes_bucket(ts: str | Column, minutes: int = 5) -> Column:
    """The minute bar is the last one of its bucket."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return (F.minute(col) + 1) % minutes == 0


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = 2 * F.pi() * value / period
    return F.sin(angle), F.cos(angle)
