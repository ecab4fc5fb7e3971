"""Time-ordered splits and folds as columns, with purge and boundary checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.plans.chunks import with_row_index

PARTS = ("train", "val", "test")


def split_by_date(
    rows: DataFrame, train_until: str, val_until: str, test_until: str, gap_days: int = 7, *, ts: str = "ts", out: str = "split"
) -> DataFrame:
    """Add ``split``; rows inside an embargo gap or after the end are dropped."""
    if train_until >= val_until:
        raise ValueError("train_until must be before val_until")
    if val_until >= test_until:
        raise ValueError("val_until must be before test_until")
    a, b, c = (F.lit(x).cast("timestamp_ntz") for x in (train_until, val_until, test_until))
    gap = F.expr(f"INTERVAL {int(gap_days)} DAYS")
    t = F.col(ts)
    part = (
        F.when(t <= a, PARTS[0])
        .when((t > a + gap) & (t <= b), PARTS[1])
        .when((t > b + gap) & (t <= c), PARTS[2])
    )
    return rows.withColumn(out, part).where(F.col(out).isNotNull())


def require_parts(rows: DataFrame, split: str = "split") -> DataFrame:
    """The frame itself, or an error when a part is empty (one small count)."""
    have = {r[0] for r in rows.select(split).distinct().limit(4).collect()}
    lacking = [p for p in PARTS if p not in have]
    if lacking:
        raise ValueError(f"empty split: {', '.join(lacking)}")
    return rows


def _cuts(train: float, val: float) -> tuple[Column, Column]:
    n = F.col("n")
    return F.floor(n * train).cast("long"), F.floor(n * val).cast("long")


def _part(idx: Column, first: Column, second: Column) -> Column:
    return F.when(idx < first, PARTS[0]).when(idx < second, PARTS[1]).otherwise(PARTS[2])


def split_by_fraction(
    rows: DataFrame,
    train: float = 0.7,
    val: float = 0.85,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    out: str = "split",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add ``split`` by position in each series: idx < floor(train*n), < floor(val*n), rest."""
    placed = with_row_index(rows, keys=keys, ts=ts)
    first, second = _cuts(train, val)
    return placed.withColumn(out, _part(F.col("idx"), first, second)).drop("idx", "n")


def purge(
    rows: DataFrame,
    window: int,
    train: float = 0.7,
    val: float = 0.85,
    *,
    anchor: str = "start",
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Fractional split with the windows that straddle a boundary removed, then split again.

    ``anchor='start'`` takes a row as the first bar of its window and removes the window-1 rows up to
    the boundary; ``'end'`` takes it as the last bar and removes the window-1 rows after it.
    """
    if anchor not in ("start", "end"):
        raise ValueError(f"unknown anchor: {anchor}")
    placed = with_row_index(rows, keys=keys, ts=ts)
    first, second = _cuts(train, val)
    i = F.col("idx")
    reach = window - 1

    def crosses(cut: Column) -> Column:
        last = cut - 1
        if anchor == "start":
            return (i <= last) & (i > last - reach)
        return (i > last) & (i <= last + reach)

    kept = placed.where(~(crosses(first) | crosses(second))).drop("idx", "n")
    return split_by_fraction(kept, train, val, keys=keys, ts=ts, chunk_rows=chunk_rows)


def ts_folds(
    rows: DataFrame,
    k: int = 5,
    *,
    gap: int = 0,
    test_size: int | None = None,
    max_train: int | None = None,
    halves: bool = False,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Expanding folds: one row per (row, fold, role), role train or test (val/test with ``halves``).

    Fold bounds are arithmetic on the row's position, so no fold table is joined.
    """
    placed = with_row_index(rows, keys=keys, ts=ts)
    n, i = F.col("n"), F.col("idx")
    size = F.lit(test_size).cast("long") if test_size else F.floor(n / (k + 1)).cast("long")

    def role(fold: Column) -> Column:
        start = n - (k - fold) * size
        train_end = start - gap
        in_train = i < train_end
        if max_train:
            in_train = in_train & (i >= train_end - max_train)
        in_test = (i >= start) & (i < start + size)
        test = F.lit("test")
        if halves:
            test = F.when(i < start + F.floor(size / 2), "val").otherwise("test")
        return F.when(in_train, "train").when(in_test, test)

    folds = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.struct(f.alias("fold"), role(f).alias("role")))
    usable = F.filter(folds, lambda f: f["role"].isNotNull())
    return placed.withColumn("_f", F.explode(usable)).select(*rows.columns, "idx", "_f.fold", "_f.role")


def walk_forward(
    rows: DataFrame,
    train: int,
    test: int,
    step: int,
    *,
    inner: float | None = None,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Rolling folds by row count; ``inner=0.7`` splits the training rows into train and val."""
    placed = with_row_index(rows, keys=keys, ts=ts)
    i, n = F.col("idx"), F.col("n")
    last = F.floor((n - train - test) / step)
    lo = F.greatest(F.ceil((i - train - test + 1) / step), F.lit(0))
    hi = F.least(F.floor(i / step), last)
    folds = F.when(hi >= lo, F.sequence(lo.cast("long"), hi.cast("long")))
    out = placed.withColumn("fold", F.explode(folds))
    pos = i - F.col("fold") * step
    role = F.when(pos >= train, "test")
    if inner is not None:
        role = role.when(pos >= int(train * inner), "val")
    return out.withColumn("role", role.otherwise("train")).select(*rows.columns, "idx", "fold", "role")


def walk_forward_days(
    rows: DataFrame,
    train_days: int = 180,
    test_days: int = 30,
    step_days: int = 30,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    out: str = "window_id",
) -> DataFrame:
    """Test rows of calendar windows; windows from the first empty one on are dropped.

    The window ids of a row follow from its distance to the series start (usually one id).
    """
    keys = tuple(keys)
    span = rows.groupBy(*keys).agg(F.min(ts).alias("_first"), F.max(ts).alias("_lastts"))
    day = 86_400.0
    base = rows.join(span, list(keys))
    def seconds(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp")) / 1_000_000.0
    since = (seconds(F.col(ts)) - seconds(F.col("_first"))) / day - train_days
    life = (seconds(F.col("_lastts")) - seconds(F.col("_first"))) / day
    lo = F.greatest(F.floor((since - test_days) / step_days) + 1, F.lit(0)).cast("long")
    hi = F.least(F.floor(since / step_days), F.ceil(life / step_days) - 1).cast("long")
    placed = base.withColumn(out, F.explode(F.when((since >= 0) & (hi >= lo), F.sequence(lo, hi)))).drop("_first", "_lastts")
    # Keep the run of windows 0,1,2,... without a gap.
    ids = placed.groupBy(*keys).agg(F.array_sort(F.collect_set(out)).alias("_ids"))
    run = F.size(F.filter(F.col("_ids"), lambda x, i: x == i))
    return placed.join(ids.select(*keys, run.alias("_run")), list(keys)).where(F.col(out) < F.col("_run")).drop("_run")


def check_folds(
    folded: DataFrame,
    window: int = 1,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    fold: str = "fold",
    role: str = "role",
) -> DataFrame:
    """Per fold: test starts after training ends, and rows between them cover a window of ``window`` rows."""
    spans = folded.groupBy(*keys, fold).agg(
        F.max(F.when(F.col(role) == "train", F.col(ts))).alias("train_max"),
        F.min(F.when(F.col(role) != "train", F.col(ts))).alias("test_min"),
        F.min(F.when(F.col(role) == "train", F.col("idx"))).alias("train_first"),
        F.max(F.when(F.col(role) == "train", F.col("idx"))).alias("train_last"),
    )
    return spans.withColumns(
        {
            "ordered": F.coalesce(F.col("test_min") > F.col("train_max"), F.lit(False)),
            "last_valid_start": F.col("train_last") - (window - 1),
            "window_fits": F.col("train_last") - (window - 1) >= F.col("train_first"),
        }
    )


def fold_summary(metrics: DataFrame, cols: Sequence[str], *, sample_std: bool = False) -> DataFrame:
    """Long table (metric, mean, std, min, max) over folds; population std unless ``sample_std``."""
    std = F.stddev_samp if sample_std else F.stddev_pop
    one = metrics.agg(
        *[
            F.struct(
                F.lit(c).alias("metric"),
                F.avg(c).alias("mean"),
                std(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in cols
        ]
    )
    return one.select(F.explode(F.array(*cols)).alias("_m")).select("_m.*")
