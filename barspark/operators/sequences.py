"""Trailing-window vectors and the row filters applied before they are built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.calendar import closes_bucket, in_session
from barspark.operators.quality import newest_rows
from barspark.plans.chunks import chunked_rows, with_row_index

# Default bounds of the row filters.
TREND_MIN_DIST, TREND_MIN_ADX, PULLBACK_MAX_RSI = -0.5, 8.0, 75.0


def trend_ok(dist: Column, adx: Column, min_dist: float | None = TREND_MIN_DIST, min_adx: float | None = TREND_MIN_ADX) -> Column:
    """Distance to the long mean and trend strength above their bounds; a bound of None is not applied."""
    ok = F.lit(True)
    if min_dist is not None:
        ok = ok & F.coalesce(dist > min_dist, F.lit(False))
    if min_adx is not None:
        ok = ok & F.coalesce(adx > min_adx, F.lit(False))
    return ok


def pullback_ok(rsi: Column, max_rsi: float | None = PULLBACK_MAX_RSI) -> Column:
    return F.lit(True) if max_rsi is None else F.coalesce(rsi < max_rsi, F.lit(False))


def sequence_names(cols: Sequence[str], window: int) -> list[str]:
    """``t-{lag}_{feature}`` in vector order: oldest bar first, features inside a bar."""
    return [f"t-{window - 1 - i}_{c}" for i in range(window) for c in cols]


def sequence(
    rows: DataFrame,
    cols: Sequence[str],
    window: int,
    *,
    keep: Column | None = None,
    out: str = "features",
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add ``out``: the last ``window`` rows' features as one array.

    Windows are positional (time gaps are ignored) and shorter ones are dropped. ``keep`` selects the
    rows that own a vector; the vector is dropped for the others before anything is shuffled again.
    """
    if window < 1:
        raise ValueError("window must be >= 1")
    if keep is not None:
        rows = rows.withColumn("_keep", keep)
    cut = chunked_rows(rows, keys=keys, ts=ts, back=window - 1, chunk_rows=chunk_rows)
    bar = F.array(*[F.col(c).cast("double") for c in cols])
    # collect_list skips null rows, so a bar is wrapped and its length is the length of the window.
    trailing = F.collect_list(F.struct(bar.alias("b"))).over(cut.line.rows(window))
    built = cut.df.withColumn("_w", trailing)
    full = F.size("_w") == window
    if keep is not None:
        full = full & F.col("_keep")
    ready = cut.trim(built.where(full))
    return ready.withColumn(out, F.flatten(F.transform("_w", lambda x: x["b"]))).drop("_w", "_keep")


def sequences(
    features: DataFrame,
    cols: Sequence[str],
    window: int,
    *,
    session: str = "all",
    session_hours: tuple[int | None, int | None] = (None, None),
    align_minutes: int | None = None,
    trend: tuple[float | None, float | None] | None = None,
    pullback: float | None = None,
    max_windows: int | None = None,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Filtered sequences: session, bucket close, trend and pullback on the last row, then the newest n."""
    keep = in_session(ts, session, *session_hours)
    if align_minutes:
        keep = keep & closes_bucket(ts, align_minutes)
    if trend is not None:
        keep = keep & trend_ok(F.col("dist_sma_200"), F.col("adx"), *trend)
    if pullback is not None:
        keep = keep & pullback_ok(F.col("rsi_m5"), pullback)
    if max_windows is None:
        return sequence(features, cols, window, keep=keep, keys=keys, ts=ts, chunk_rows=chunk_rows)
    marked = features.withColumn("_own", keep)
    # The cap is decided on narrow rows first; only the rows that survive carry a vector.

    placed = with_row_index(marked, keys=keys, ts=ts, index="_i", total="_n")
    own = placed.where(F.col("_own") & (F.col("_i") >= window - 1)).select(*keys, ts)
    newest = newest_rows(own, max_windows, ts, *keys).withColumn("_new", F.lit(True))
    capped = marked.drop("_own").join(newest, [*keys, ts], "left")
    return sequence(
        capped, cols, window, keep=F.coalesce(F.col("_new"), F.lit(False)), keys=keys, ts=ts, chunk_rows=chunk_rows
    ).drop("_new")


def explode_sequence(rows: DataFrame, cols: Sequence[str], window: int, *, features: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """Long form (kept columns, pos, lag, feature, value) of sequence vectors."""
    n = len(cols)
    names = F.array(*[F.lit(c) for c in cols])
    long = rows.select(*keep, F.posexplode(features).alias("pos", "value"))
    return long.select(
        *keep,
        "pos",
        (window - 1 - F.floor(F.col("pos") / n)).cast("int").alias("lag"),
        F.get(names, F.col("pos") % n).alias("feature"),
        "value",
    )
