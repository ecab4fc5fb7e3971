"""One position at a time over a long series, by step functions that combine in a tree.

What the trades before a stretch of rows mean for it is a small state: the time from which a position may be
opened, and how many were opened on that day. So a stretch is a step function from the state before to the state
after it. Two neighbouring stretches combine to one of the same kind, and FAN of them are combined in
a task, then FAN of these, up to one per series. On the way down every stretch gets the state it starts
from. No task sees more than FAN functions, and no stretch waits for the one before.

A function is a table of pieces: for each count u of positions already open that day (0 wherever the first
position would fall on another day), the latest ``upto`` a piece holds for, the day of the position it begins
with, and the state after it: end, used, last (the day counted); end KEEP where nothing is opened.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.plans.chunks import join_on
from barspark.session import cut_lineage

FAN = 64
NEVER = np.iinfo(np.int64).min
KEEP = np.iinfo(np.int64).max
PIECE = ("u", "upto", "day", "end", "used", "last")
STATE = ("free", "day", "used")


def _fixed_point(to: np.ndarray) -> np.ndarray:
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def _power(step: np.ndarray, moves: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Place after so many steps and the number that moved, from each place."""
    at, n = np.arange(len(step)), np.zeros(len(step), np.int64)
    while times:
        if times & 1:
            at, n = step[at], n + moves[at]
        step, moves = step[step], moves + moves[step]
        times >>= 1
    return at, n


def _merged(pieces: np.ndarray) -> np.ndarray:
    """Neighbouring pieces that agree in all but ``upto`` are one. Rows are sorted by u and upto."""
    if len(pieces) < 2:
        return pieces
    rest = pieces[:, [0, 2, 3, 4, 5]]
    return pieces[np.append((rest[1:] != rest[:-1]).any(axis=1), True)]


def pieces_of(starts: np.ndarray, ends: np.ndarray, days: np.ndarray, cap: int) -> np.ndarray:
    """The function of a stretch whose rows are sorted by start and end. ``cap`` 0 means no limit a day."""
    n = len(starts)
    here = np.arange(n)
    after = np.maximum(np.searchsorted(starts, ends, side="left"), here + 1)

    def table(u: int, upto, day, end, used, last) -> np.ndarray:
        return np.stack([np.broadcast_to(np.asarray(x, np.int64), np.shape(upto)) for x in (u, upto, day, end, used, last)], axis=1)

    if not cap:
        at = _fixed_point(np.where(after < n, after, here))
        return _merged(table(0, starts, days, ends[at], 0, days[at]))
    inside = (after < n) & (days[np.minimum(after, n - 1)] == days)
    step, moves = np.where(inside, after, here), inside.astype(np.int64)
    next_day = np.searchsorted(days, days, side="right")

    def day_run(k: int, allowed: int, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last place of the run of at most ``allowed`` positions of the first ``upto`` places, their number, and the place after."""
        at, more = _power(step[:upto], moves[:upto], allowed - 1)
        number = more + 1
        return at, number, np.where(number == allowed, np.maximum(after[at], next_day[:upto]), after[at])

    at, number, then = day_run(0, cap, n)
    top = _fixed_point(np.where(then < n, then, here))
    end, used, last = ends[at[top]], number[top], days[at[top]]
    tables = [table(0, starts, days, end, used, last)]
    m = int(next_day[0])  # rows of the first day
    for u in range(1, cap):
        at, number, then = day_run(u, cap - u, m)
        j, more = np.minimum(then, n - 1), then < n
        tables.append(table(u, starts[:m], days[:m], np.where(more, end[j], ends[at]), np.where(more, used[j], u + number), np.where(more, last[j], days[0])))
    full = (end[m], used[m], last[m]) if m < n else (KEEP, 0, 0)
    tables.append(table(cap, starts[m - 1 : m], days[:1], *full))
    return np.concatenate([_merged(t) for t in tables])


def follow(pieces: np.ndarray, free: np.ndarray, day: np.ndarray, used: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, ...]:
    """States after a stretch, from states before it; ``moved`` tells whether a position was opened so far."""
    first = pieces[pieces[:, 0] == 0]
    at = np.searchsorted(first[:, 1], free, side="left")
    hit = at < len(first)
    same = hit & (first[np.minimum(at, len(first) - 1), 2] == day)
    u = np.where(same, used, 0)
    out = [x.copy() for x in (free, day, used, moved)]
    for k in np.unique(u[hit]).tolist():
        own = pieces[pieces[:, 0] == k]
        mine = np.flatnonzero(hit & (u == k))
        to = own[np.searchsorted(own[:, 1], free[mine], side="left")]
        opened = to[:, 3] != KEEP
        mine, to = mine[opened], to[opened]
        out[0][mine], out[1][mine], out[2][mine], out[3][mine] = to[:, 3], to[:, 5], to[:, 4], True
    return tuple(out)


def combined(parts: Sequence[np.ndarray]) -> np.ndarray:
    """The function of neighbouring stretches."""
    day0, reached, found = parts[0][0, 2], NEVER, []
    for c, own in enumerate(parts):
        fresh = own[(own[:, 1] > reached) & ((own[:, 0] == 0) | (own[:, 2] == day0))]
        u, upto, day = fresh[:, 0], fresh[:, 1], fresh[:, 2]
        state = (upto.copy(), np.where(u > 0, day, NEVER), u.copy(), np.zeros(len(u), bool))
        for later in parts[c:]:
            state = follow(later, *state)
        free, last, used, moved = state
        found.append(np.stack([u, upto, day, np.where(moved, free, KEEP), np.where(moved, used, 0), np.where(moved, last, 0)], axis=1))
        reached = max(reached, int(own[own[:, 0] == 0][-1, 1]))
    pieces = np.concatenate(found)
    return _merged(pieces[np.lexsort((pieces[:, 1], pieces[:, 0]))])


def _arrays(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[list(PIECE)].to_numpy(np.int64)


def entry_states(solved: DataFrame, key_fields: Sequence[T.StructField]) -> DataFrame:
    """(keys, at, free, day, used): the state before each stretch, from (keys, at, pieces) with ``at`` 0, 1, 2 ... per series."""
    keys = [f.name for f in key_fields]
    piece = T.StructType([*key_fields, T.StructField("at", T.LongType()), *[T.StructField(c, T.LongType()) for c in PIECE]])
    state = T.StructType([*key_fields, T.StructField("at", T.LongType()), *[T.StructField(c, T.LongType()) for c in STATE]])

    def named(pdf: pd.DataFrame, data: dict, order: Sequence[str]) -> pd.DataFrame:
        out = pd.DataFrame(data)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, *order]]

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "u", "upto"], kind="stable")
        got = combined([_arrays(part) for _, part in pdf.groupby("at", sort=True)])
        return named(pdf, {"at": int(pdf["_up"].iloc[0]), **dict(zip(PIECE, got.T, strict=True))}, ["at", *PIECE])

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "u", "upto"], kind="stable")
        now = tuple(pdf[f"_s_{c}"].iloc[:1].to_numpy(np.int64) for c in STATE)
        lines = []
        for at, part in pdf.groupby("at", sort=True):
            lines.append((at, *(int(x[0]) for x in now)))
            now = follow(_arrays(part), *now, np.zeros(1, bool))[:3]
        at, *now = zip(*lines, strict=True)
        return named(pdf, {"at": at, **dict(zip(STATE, now, strict=True))}, ["at", *STATE])

    up = F.floor(F.col("at") / FAN)
    levels = [solved]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) > 0:
        levels.append(cut_lineage(levels[-1].withColumn("_up", up).groupBy(*keys, "_up").applyInPandas(combine, piece)))
    before = levels[-1].select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("at"), F.lit(int(NEVER)).alias("free"), F.lit(int(NEVER)).alias("day"), F.lit(0).cast("long").alias("used"))
    for level in reversed(levels[:-1]):
        given = before.select(*keys, F.col("at").alias("_up"), *[F.col(c).alias(f"_s_{c}") for c in STATE])
        before = join_on(level.withColumn("_up", up), given, [*keys, "_up"]).groupBy(*keys, "_up").applyInPandas(hand_down, state)
        before = cut_lineage(before)
    return before
