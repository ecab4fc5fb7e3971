"""Running totals, running extremes, carry-forward, ranks and exact quantiles in two levels.

First level inside a slice of time (or a stretch of ordered values), second level over one row per slice,
then the carry is joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.plans.chunks import SLICE, UNIT, join_on, slice_of
from barspark.plans.series import cut_series

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    columns: Mapping[str, tuple[str, str]],
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    order: Sequence[str] | None = None,
    unit: str = UNIT,
) -> DataFrame:
    """Add ``out -> (kind, column)`` with kind sum, max, min or last (last non-null value so far)."""
    order = tuple(order or (ts,))
    keys = tuple(keys)
    df = df.withColumn(SLICE, slice_of(ts, unit))
    w = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def local(kind: str, col: str) -> Column:
        return F.last(col, ignorenulls=True).over(w) if kind == "last" else _AGG[kind](col).over(w)

    rank = F.struct(*order)
    totals = df.groupBy(*keys, SLICE).agg(
        *[
            (F.max_by(col, F.when(F.col(col).isNotNull(), rank)) if kind == "last" else _AGG[kind](col)).alias(f"_t_{out}")
            for out, (kind, col) in columns.items()
        ]
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        SLICE,
        *[
            (F.last(f"_t_{out}", ignorenulls=True) if kind == "last" else _AGG[kind](f"_t_{out}")).over(before).alias(f"_c_{out}")
            for out, (kind, _) in columns.items()
        ],
    )
    staged = df.withColumns({f"_l_{out}": local(kind, col) for out, (kind, col) in columns.items()})
    joined = join_on(staged, carry, [*keys, SLICE])

    def merged(out: str, kind: str) -> Column:
        mine, earlier = F.col(f"_l_{out}"), F.col(f"_c_{out}")
        if kind == "sum":
            return F.when(mine.isNull() & earlier.isNull(), None).otherwise(
                F.coalesce(mine, F.lit(0)) + F.coalesce(earlier, F.lit(0))
            )
        if kind == "last":
            return F.coalesce(mine, earlier)
        return (F.greatest if kind == "max" else F.least)(mine, earlier)

    helpers = [f"_{p}_{out}" for out in columns for p in "lc"]
    return joined.withColumns({out: merged(out, kind) for out, (kind, _) in columns.items()}).drop(SLICE, *helpers)


def value_scan(df: DataFrame, value: str, sums: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, value): the summed columns and, as ``<col>_below``, their sum over smaller values.

    Equal values are merged before they are dealt to ranges, so a hot value is one row; the ranges follow the rows.
    """
    merged = df.groupBy(*keys, value).agg(*[F.sum(c).alias(c) for c in sums])
    below = cut_series(merged, keys=keys, order=(value,)).running({f"{c}_below": ("sum", c) for c in sums}, before=True).rows
    return below.withColumns({f"{c}_below": F.coalesce(f"{c}_below", F.lit(0)) for c in sums})


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    *,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Long table (keys, prob, q): linearly interpolated exact quantiles.

    ``percentile`` would keep every distinct value of a group in one task; here the two neighbouring
    order statistics are found from distributed ranks, and equal neighbours give exactly their value.
    """
    keys = tuple(keys)
    probs = [float(p) for p in probs]
    data = df.where(F.col(value).isNotNull())
    ranked = value_scan(data.select(*keys, value).withColumn("_one", F.lit(1)), value, ["_one"], keys=keys)
    totals = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = join_on(ranked, totals, keys) if keys else ranked.withColumn("_n", totals.scalar())
    want = F.array(*[F.lit(p) for p in probs])
    spots = F.transform(want, lambda p: F.struct(p.alias("prob"), (p * (F.col("_n") - 1)).alias("pos")))
    lo, hi = F.col("_one_below"), F.col("_one_below") + F.col("_one") - 1
    hits = F.filter(
        spots,
        lambda s: (F.floor(s["pos"]).between(lo, hi)) | (F.ceil(s["pos"]).between(lo, hi)),
    )
    rows = ranked.select(*keys, value, lo.alias("_lo"), hi.alias("_hi"), F.explode(hits).alias("_s"))
    at_floor = F.floor("_s.pos").between(F.col("_lo"), F.col("_hi"))
    at_ceil = F.ceil("_s.pos").between(F.col("_lo"), F.col("_hi"))
    part = F.col("_s.pos") - F.floor("_s.pos")
    return (
        rows.groupBy(*keys, F.col("_s.prob").alias("prob"))
        .agg(
            F.max(F.when(at_floor, F.col(value))).alias("_a"),
            F.max(F.when(at_ceil, F.col(value))).alias("_b"),
            F.max(part).alias("_f"),
        )
        .select(*keys, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("q"))
    )
