"""Bars: rollup, alignment between bar widths, prior-day context, latest slices, date filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.functions.study import Study
from barspark.plans.chunks import join_on, with_row_index
from barspark.plans.scan import running

# Above the range of a 64-bit tie.
TIE_SPAN = "20000000000000000000"
OHLCV = ("open", "high", "low", "close", "volume")


def ticks_as_bars(ticks: DataFrame, *, symbol: str, ts: str, price: str, tie: str, volume: str | None = None) -> DataFrame:
    """One-price rows in bar shape (volume 1 per tick unless a column is given)."""
    p = F.col(price).cast("double")
    v = F.col(volume).cast("double") if volume else F.lit(1.0)
    return ticks.select(
        F.col(symbol).alias("symbol"),
        F.col(ts).cast("timestamp_ntz").alias("ts"),
        p.alias("open"),
        p.alias("high"),
        p.alias("low"),
        p.alias("close"),
        v.alias("volume"),
        F.col(tie).alias("tie"),
    )


def bucket_start(ts: str | Column, width: str) -> Column:
    """Start of the left-closed bucket the row falls in."""
    return F.window(ts, width)["start"]


def row_rank(bars: DataFrame, ts: str, tie: str | None) -> Column:
    """Order of rows inside a bucket: time, then ``tie``.

    An integer tie is packed with the microseconds into one decimal, which keeps the rollup a hash
    aggregate; a struct would turn it into a sort.
    """
    if tie is None:
        return F.col(ts)
    if not isinstance(bars.schema[tie].dataType, T.IntegralType):
        return F.struct(ts, tie)
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(18,0)")
    return micros * F.lit(TIE_SPAN).cast("decimal(20,0)") + F.col(tie).cast("decimal(19,0)")


def rollup_bars(
    bars: DataFrame,
    width: str,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    tie: str | None = None,
    start: str | None = None,
    end: str | None = None,
    with_end: bool = False,
) -> DataFrame:
    """OHLCV over left-closed, left-labelled buckets; empty buckets do not appear.

    ``start``/``end`` (inclusive) filter before the rollup, so no bucket mixes rows outside the range.
    ``tie`` orders rows that share a timestamp.
    """
    if start is not None:
        bars = bars.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bars = bars.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    rank = row_rank(bars, ts, tie)
    out = bars.groupBy(*keys, F.window(ts, width).alias("_w")).agg(
        F.min_by("open", rank).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", rank).alias("close"),
        F.sum("volume").alias("volume"),
    )
    extra = [F.col("_w.end").alias("bar_end")] if with_end else []
    return out.select(*keys, F.col("_w.start").alias("ts"), *OHLCV, *extra)


def require_bars(bars: DataFrame, at_least: int, keys: Sequence[str] = ("symbol",)) -> None:
    """Raise when a key has fewer rows than an operator's warm-up (one counting job)."""
    short = bars.groupBy(*keys).count().where(F.col("count") < at_least).limit(1).collect()
    if short:
        raise ValueError(f"insufficient data: need at least {at_least} bars, got {short[0]['count']}")


def asof_last(
    left: DataFrame,
    right: DataFrame,
    cols: Sequence[str],
    *,
    keys: Sequence[str] = ("symbol",),
    left_time: str = "ts",
    right_time: str = "ts",
    strict: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Every left row with the last right row whose time is <= (``strict``: <) its own.

    Both sides are stacked and the right values carried forward in time order, so no pairs are formed.
    """
    keys = tuple(keys)
    time = F.col(left_time).alias("_at")
    payload = F.struct(*[F.col(c) for c in left.columns])
    value = F.struct(*[F.col(c) for c in cols])
    none_value = F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)
    none_row = F.lit(None).cast(left.select(payload.alias("p")).schema["p"].dataType)
    first, second = (0, 1) if not strict else (1, 0)
    stacked = right.select(
        *keys, F.col(right_time).alias("_at"), F.lit(first).alias("_side"), none_row.alias("_row"), value.alias("_val")
    ).unionByName(left.select(*keys, time, F.lit(second).alias("_side"), payload.alias("_row"), none_value.alias("_val")))
    filled = running(
        stacked,
        {"_seen": ("last", "_val")},
        keys=keys,
        ts="_at",
        order=("_at", "_side"),
    )
    return filled.where(F.col("_row").isNotNull()).select("_row.*", *[F.col(f"_seen.{c}").alias(c) for c in cols])


def asof_align(
    fine: DataFrame,
    coarse: DataFrame,
    cols: Sequence[str],
    width: str,
    *,
    mode: str = "close",
    fine_width: str | None = None,
    fill: dict[str, float] | None = None,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    gaps: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Bring columns of coarse bars to fine bars.

    ``mode='open'`` shows a coarse bar from its start (it then contains later fine bars);
    ``mode='close'`` shows it only on the fine bar that completes it and after.
    When the coarse bars are a rollup of the fine ones every fine row has its bucket, so this is an
    equi-join on the bucket; ``gaps=True`` handles independent tables by carrying values forward.
    """
    if mode not in ("open", "close"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "close" and fine_width is None:
        raise ValueError("close mode needs fine_width")
    keys = tuple(keys)
    span = F.expr(f"INTERVAL {width}")
    if gaps:
        seen = coarse.select(*keys, *cols, (F.col(ts) + span if mode == "close" else F.col(ts)).alias("_vis"))
        at = F.col(ts) + F.expr(f"INTERVAL {fine_width}") if mode == "close" else F.col(ts)
        out = asof_last(
            fine.withColumn("_vis", at), seen, cols, keys=keys, left_time="_vis", right_time="_vis", chunk_rows=chunk_rows
        ).drop("_vis")
    else:
        side = coarse.select(*keys, F.col(ts).alias("_b"), *cols)
        if mode == "close":
            study = Study()
            before = {c: study.out(f"_p_{c}", study.prev(c)) for c in cols}
            side = study.apply(side, keys=keys, ts="_b", chunk_rows=chunk_rows)
        staged = fine.withColumn("_b", bucket_start(ts, width))
        joined = staged.join(side, [*keys, "_b"], "left")
        if mode == "close":
            done = F.col(ts) + F.expr(f"INTERVAL {fine_width}") >= F.col("_b") + span
            joined = joined.withColumns({c: F.when(done, F.col(c)).otherwise(F.col(before[c])) for c in cols}).drop(
                *before.values()
            )
        out = joined.select(*fine.columns, *cols)
    if fill:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items() if c in cols})
    return out


def prev_day(
    bars: DataFrame, *, strict_calendar: bool = True, keys: Sequence[str] = ("symbol",), ts: str = "ts", chunk_rows=None
) -> DataFrame:
    """Add prev_high, prev_low, prev_close of the day before.

    Strict: the calendar day before (null after a gap such as a weekend); otherwise the last day with bars.
    """
    keys = tuple(keys)
    days = rollup_bars(bars, "1 day", keys=keys, ts=ts).select(
        *keys, F.to_date("ts").alias("_d"), "high", "low", "close"
    )
    names = {"high": "prev_high", "low": "prev_low", "close": "prev_close"}
    if strict_calendar:
        side = days.select(*keys, F.date_add("_d", 1).alias("_d"), *[F.col(c).alias(n) for c, n in names.items()])
    else:
        study = Study()
        for c, n in names.items():
            study.out(n, study.prev(c))
        side = study.apply(days, keys=keys, ts="_d", chunk_rows=chunk_rows, unit="year").select(*keys, "_d", *names.values())
    return bars.withColumn("_d", F.to_date(ts)).join(side, [*keys, "_d"], "left").drop("_d")


def latest_bars(
    bars: DataFrame, *, days: int | None = None, n: int | None = None, keys: Sequence[str] = ("symbol",), ts: str = "ts"
) -> DataFrame:
    """Rows of the last ``days`` days, or the last ``n`` rows, per key."""
    if (days is None) == (n is None):
        raise ValueError("give exactly one of days and n")
    if days is not None:
        newest = bars.groupBy(*keys).agg(F.max(ts).alias("_newest"))
        joined = join_on(bars, newest, keys)
        return joined.where(F.col(ts) >= F.col("_newest") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("_newest")
    placed = with_row_index(bars, keys=keys, ts=ts, index="_i", total="_n")
    return placed.where(F.col("_i") >= F.col("_n") - n).drop("_i", "_n")


def require_rows(bars: DataFrame, n: int) -> DataFrame:
    """The frame itself, or an error when it has fewer than n rows (checked with a bounded take)."""
    got = bars.limit(n).count()
    if got < n:
        raise ValueError(f"need at least {n} rows, got {got}")
    return bars


def drop_date_prefix(rows: DataFrame, col: str, prefix: str) -> DataFrame:
    return rows.where(~F.col(col).startswith(prefix))


def align_rows(*frames: DataFrame, on: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Inner alignment of frames on the index columns."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, list(on), "inner")
    return out


def rows_in(frame: DataFrame, index: DataFrame, on: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Rows whose index appears in the other frame."""
    return frame.join(index.select(*on), list(on), "left_semi")


def next_bar_return(
    bars: DataFrame,
    *,
    spread: float = 0.0001,
    commission: float = 0.0005,
    out: str = "next_return",
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Return of buying at this close and selling at the next one, after half-spread and commission."""
    study = Study()
    after = study.put("_after", ["close"], lambda line: line.next("close"), ahead=1)
    sell = (1 - spread / 2) * (1 - commission)
    buy = (1 + spread / 2) * (1 + commission)
    study.out(out, study.calc("_ret", [after, "close"], lambda: F.try_divide(F.col(after) * sell, F.col("close") * buy) - 1))
    return study.apply(bars, keys=keys, ts=ts, chunk_rows=chunk_rows)


