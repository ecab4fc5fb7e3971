"""Windows over long series without one task per key.

A window partitioned by ``symbol`` alone puts a whole symbol into one task. Here a series is cut into
chunks of whole time slices, and every chunk also receives the rows just before and after it (its
halo), so any frame that reaches at most ``back`` rows back and ``ahead`` rows forward is exact inside
``(symbol, chunk)``. The cut comes from the row count per (key, slice), a small table: its length is
bounded by the calendar, not by the number of rows.

The plan is the same for every size: a series shorter than a chunk is one chunk. An operator of several steps
starts from a written cut instead, see ``series.py``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_ROWS = 500_000
CHUNK = "_chunk"
CORE = "_core"
SLICE = "_slice"
#: Rows are counted per hour, so that a day of very many rows is cut as well.
UNIT = "hour"


@dataclass(frozen=True)
class Line:
    """Row order inside one window partition."""

    part: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def rows(self, n: int) -> WindowSpec:
        """The current row and the n-1 rows before it."""
        return self.ordered.rowsBetween(1 - n, 0)

    def between(self, lo: int, hi: int) -> WindowSpec:
        return self.ordered.rowsBetween(lo, hi)

    @property
    def so_far(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def prev(self, col: str | Column, k: int = 1) -> Column:
        return F.lag(col, k).over(self.ordered)

    def next(self, col: str | Column, k: int = 1) -> Column:
        return F.lead(col, k).over(self.ordered)


@dataclass(frozen=True)
class ChunkedRows:
    """Rows with chunk id and core flag, ready for windows on ``line``."""

    df: DataFrame
    line: Line

    def trim(self, df: DataFrame) -> DataFrame:
        """Drop the halo copies and the helper columns."""
        return df.where(F.col(CORE)).drop(CHUNK, CORE)


def join_on(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null meets null, so rows without a key or time stay in their own group."""
    named = side.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return df.join(named, same, how).drop(*[f"_on_{k}" for k in keys])


def slice_of(ts: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")


def slice_counts(df: DataFrame, keys: Sequence[str], ts: str, unit: str = UNIT) -> DataFrame:
    """Rows per (key, slice) with the number of rows before the slice (``_start``) and in all (``_total``)."""
    counts = (
        df.select(*keys, slice_of(ts, unit).alias(SLICE))
        .groupBy(*keys, SLICE)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return counts.select(
        *keys,
        SLICE,
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(whole).alias("_total"),
        F.max("_n").over(whole).alias("_widest"),
    )


def chunked_rows(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    order: Sequence[str] | None = None,
    back: int = 0,
    ahead: int = 0,
    chunk_rows: int | None = None,
    unit: str = UNIT,
) -> ChunkedRows:
    """Cut every series into chunks of about ``chunk_rows`` rows (CHUNK_ROWS by default) plus halo."""
    order = tuple(order or (ts,))
    keys = tuple(keys)
    rows = max(chunk_rows or CHUNK_ROWS, 1)
    own = F.floor(F.col("_start") / rows)
    first = own
    if ahead:
        reach = F.floor((F.col("_start") - F.col("_widest") - (ahead - 1)) / rows)
        first = F.greatest(F.least(reach, own), F.lit(0))
    last = own
    if back:
        reach = F.floor((F.col("_start") + F.col("_n") + (back - 1)) / rows)
        newest = F.floor((F.col("_total") - 1) / rows)
        last = F.greatest(F.least(reach, newest), own)
    cuts = slice_counts(df, keys, ts, unit).select(
        *keys, SLICE, own.alias("_own"), F.sequence(first, last).alias("_to")
    )
    spread = (
        join_on(df.withColumn(SLICE, slice_of(ts, unit)), cuts, [*keys, SLICE])
        .withColumn(CHUNK, F.explode("_to"))
        .withColumn(CORE, F.col(CHUNK) == F.col("_own"))
        .drop(SLICE, "_own", "_to")
    )
    return ChunkedRows(spread, Line((*keys, CHUNK), order))


def with_row_index(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    order: Sequence[str] | None = None,
    index: str = "idx",
    total: str = "n",
    unit: str = UNIT,
) -> DataFrame:
    """0-based position of each row in its series and the length of the series.

    Position = rows in earlier slices + row number inside the slice, so no task sees more than one slice of
    one key.
    """
    order = tuple(order or (ts,))
    keys = tuple(keys)
    cuts = slice_counts(df, keys, ts, unit).select(*keys, SLICE, "_start", F.col("_total").alias(total))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    return (
        join_on(df.withColumn(SLICE, slice_of(ts, unit)).withColumn("_r", F.row_number().over(inside)), cuts, [*keys, SLICE])
        .withColumn(index, F.col("_start") + F.col("_r") - 1)
        .drop(SLICE, "_start", "_r")
    )
