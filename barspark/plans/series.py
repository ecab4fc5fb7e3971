"""One cut of a series, written once: every row with its stretch, its position and the length of its series.

Rows are dealt to ranges of (keys, order), so a stretch is a part of one series that fits a task, however
its rows lie in time. A row's position is its place in its range plus the rows of the series in the ranges
before: a sum over one row per stretch. The rows are written with their place; whatever an operator does in
several steps starts from this table, so its input is read twice in all (to find the ranges, and to write).

Running values are computed inside stretches and carried over one row per stretch. Frames that reach a
bounded number of rows are computed in chunks of positions, which also get the rows their frames reach; chunks
follow from positions alone, without a further join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.plans.chunks import CHUNK, CHUNK_ROWS, CORE, ChunkedRows, Line, join_on
from barspark.session import cut_lineage

STRETCH, IDX, LEN = "_stretch", "_idx", "_len"
PART, _ROW = "_part", "_row"
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Series:
    """A written cut. ``df`` has the rows with STRETCH, IDX and LEN."""

    df: DataFrame
    keys: tuple[str, ...]

    def having(self, df: DataFrame) -> Series:
        """The same cut with other columns or fewer rows."""
        return replace(self, df=df)

    @property
    def rows(self) -> DataFrame:
        return self.df.drop(STRETCH, IDX, LEN)

    def running(self, columns: Mapping[str, tuple[str, str]], *, before: bool = False) -> Series:
        """Add ``out -> (kind, column)``: the running sum, max, min or last (non-null value) up to the row.

        With ``before`` the row itself is left out. Null where no row has a value yet.
        """
        upto = -1 if before else 0
        here = Window.partitionBy(*self.keys, STRETCH).orderBy(IDX).rowsBetween(Window.unboundedPreceding, upto)
        earlier = Window.partitionBy(*self.keys).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)

        def over(kind: str, col: str, w) -> Column:
            return F.last(col, ignorenulls=True).over(w) if kind == "last" else _AGG[kind](col).over(w)

        def whole(kind: str, col: str) -> Column:
            return F.max_by(col, F.when(F.col(col).isNotNull(), F.col(IDX))) if kind == "last" else _AGG[kind](col)

        def merged(out: str, kind: str) -> Column:
            mine, old = F.col(f"_l_{out}"), F.col(f"_c_{out}")
            if kind == "sum":
                return F.when(mine.isNull(), old).when(old.isNull(), mine).otherwise(mine + old)
            if kind == "last":
                return F.coalesce(mine, old)
            return (F.greatest if kind == "max" else F.least)(mine, old)

        totals = self.df.groupBy(*self.keys, STRETCH).agg(*[whole(kind, col).alias(f"_t_{out}") for out, (kind, col) in columns.items()])
        carry = totals.select(*self.keys, STRETCH, *[over(kind, f"_t_{out}", earlier).alias(f"_c_{out}") for out, (kind, _) in columns.items()])
        local = self.df.withColumns({f"_l_{out}": over(kind, col, here) for out, (kind, col) in columns.items()})
        joined = join_on(local, carry, [*self.keys, STRETCH])
        helpers = [f"_{p}_{out}" for out in columns for p in "lc"]
        return self.having(joined.withColumns({out: merged(out, kind) for out, (kind, _) in columns.items()}).drop(*helpers))

    def chunks(self, back: int = 0, ahead: int = 0, chunk_rows: int | None = None) -> ChunkedRows:
        """Chunks of positions with the ``back`` rows before and ``ahead`` rows after each. Needs all rows of the cut."""
        rows = max(chunk_rows or CHUNK_ROWS, 1)
        at = lambda i: F.floor(i / rows)
        first = at(F.greatest(F.col(IDX) - ahead, F.lit(0)))
        last = at(F.least(F.col(IDX) + back, F.col(LEN) - 1))
        spread = self.df.withColumn(CHUNK, F.explode(F.sequence(first, last)))
        return ChunkedRows(spread.withColumn(CORE, F.col(CHUNK) == at(F.col(IDX))), Line((*self.keys, CHUNK), (IDX,)))


def cut_series(df: DataFrame, *, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), part_rows: int | None = None) -> Series:
    """Write the rows of ``df`` with their stretch and position by ``order`` in their series. Nulls come first.

    Ranges are as large as the session's shuffle partitions; ``part_rows`` gives their rows instead (and counts the input).
    """
    keys = tuple(keys)
    by = [F.col(c) for c in (*keys, *order)]
    parts = -(-df.count() // part_rows) if part_rows else 0
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    placed = dealt.sortWithinPartitions(*by).withColumns({PART: F.spark_partition_id(), _ROW: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    written = cut_lineage(placed)
    stretches = written.groupBy(*keys, PART).agg(F.min(_ROW).alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole, earlier = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(PART)) - 1
    stretches = stretches.select(*keys, PART, offset.alias("_offset"), F.sum("_n").over(whole).alias(LEN), place.cast("long").alias(STRETCH))
    rows = join_on(written, stretches, [*keys, PART])
    return Series(rows.withColumn(IDX, F.col(_ROW) + F.col("_offset")).drop(_ROW, "_offset", PART), keys)
