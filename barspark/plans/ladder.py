"""Searching forward in a series without pairing every entry with every later bar.

``first_touch`` climbs calendar blocks: bars of a day, days of a month, months of a year, years. Every
block is one array row (its length is bounded by the calendar), so each step is an equi-join that adds
one row per entry. ``forward_bars`` fetches a bounded number of following bars from index blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.plans.chunks import with_row_index

RUNGS = ("day", "month", "year")
TIES = ("near_open", "loss", "tp_first")


def _trunc(col: Column, unit: str) -> Column:
    return F.date_trunc(unit, col).cast("timestamp_ntz")


def _hits(items: Column, sl: Column, tp: Column, after: Column | None = None) -> Column:
    """Items of a block that reach a level, optionally only those after a time."""
    if after is None:
        return F.filter(items, lambda b: (b["low"] <= sl) | (b["high"] >= tp))
    return F.filter(items, lambda b: (b["ts"] > after) & ((b["low"] <= sl) | (b["high"] >= tp)))


def first_touch(
    entries: DataFrame,
    bars: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    sl: str = "sl_price",
    tp: str = "tp_price",
    out: str = "touch",
    rungs: Sequence[str] = RUNGS,
) -> DataFrame:
    """Add ``out`` = struct(ts, open, high, low) of the first bar after the entry that reaches sl or tp.

    Null where no bar in the data does.
    """
    keys = tuple(keys)
    rungs = tuple(rungs)
    # Block tables: level 0 holds bars per day, level i holds blocks of level i-1 per rungs[i].
    item = F.struct(F.col(ts).alias("ts"), *["open", "high", "low"])
    level0 = bars.groupBy(*keys, _trunc(F.col(ts), rungs[0]).alias("_b0")).agg(
        F.array_sort(F.collect_list(item)).alias("_a0")
    )
    tables = [level0]
    for i in range(1, len(rungs) + 1):
        span = _trunc(F.col(ts), rungs[i - 1])
        sums = bars.groupBy(*keys, span.alias("ts")).agg(F.max("high").alias("high"), F.min("low").alias("low"))
        part = [_trunc(F.col("ts"), rungs[i]).alias(f"_b{i}")] if i < len(rungs) else []
        tables.append(
            sums.groupBy(*keys, *part).agg(F.array_sort(F.collect_list(F.struct("ts", "high", "low"))).alias(f"_a{i}"))
        )
    top = len(rungs)
    sl_c, tp_c = F.col(sl), F.col(tp)
    found = entries
    # Up: the rest of the entry's own block on every level.
    for i in range(top + 1):
        on = list(keys)
        if i < top:
            found = found.withColumn(f"_b{i}", _trunc(F.col(ts), rungs[i]))
            on.append(f"_b{i}")
        after = F.col(ts) if i == 0 else _trunc(F.col(ts), rungs[i - 1])
        hits = _hits(F.col(f"_a{i}"), sl_c, tp_c, after)
        found = found.join(tables[i], on, "left").withColumn(f"_h{i}", F.get(hits, F.lit(0))).drop(f"_a{i}")
    # Down: open the block that was found; resolved entries rejoin their own block and ignore it.
    where = F.col(f"_h{top}.ts")
    for i in range(top - 1, -1, -1):
        target = F.coalesce(F.when(F.col(f"_h{i}").isNull(), where), F.col(f"_b{i}"))
        side = tables[i].withColumnRenamed(f"_b{i}", "_t")
        staged = found.withColumn("_t", target).join(side, [*keys, "_t"], "left")
        hits = _hits(F.col(f"_a{i}"), sl_c, tp_c)
        deeper = F.when(F.col(f"_h{i}").isNull() & where.isNotNull(), F.get(hits, F.lit(0)))
        found = staged.withColumn(f"_h{i}", F.coalesce(F.col(f"_h{i}"), deeper)).drop("_t", f"_a{i}")
        where = F.col(f"_h{i}.ts")
    return found.withColumn(out, F.col("_h0")).drop(
        *[f"_b{i}" for i in range(top)], *[f"_h{i}" for i in range(top + 1)]
    )


def target_first(touch: Column, sl: Column, tp: Column, tie: str) -> Column:
    """True when the target, not the stop, closes the trade on the touched bar."""
    if tie not in TIES:
        raise ValueError(f"unknown tie rule: {tie}")
    hit_sl, hit_tp = touch["low"] <= sl, touch["high"] >= tp
    if tie == "loss":
        both = F.lit(False)
    elif tie == "tp_first":
        both = F.lit(True)
    else:
        both = F.abs(touch["open"] - tp) < F.abs(touch["open"] - sl)
    return F.when(hit_sl & hit_tp, both).otherwise(hit_tp)


def forward_bars(
    entries: DataFrame,
    bars: DataFrame,
    reach: int,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    out: str = "forward",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add ``out``: array of up to ``reach`` bars after the entry's bar, and ``n_bars`` of its series.

    Bars are stored in index blocks of ``reach`` rows, so two equi-joins cover any entry.
    """
    keys = tuple(keys)
    cols = ["idx", ts, "open", "high", "low", "close"]
    placed = with_row_index(bars.select(*keys, *cols[1:]), keys=keys, ts=ts, index="idx", total="n_bars")
    blocks = placed.groupBy(*keys, F.floor(F.col("idx") / reach).alias("_blk")).agg(
        F.array_sort(F.collect_list(F.struct(*cols))).alias("_rows")
    )
    found = entries.join(placed.select(*keys, ts, F.col("idx").alias("_at"), "n_bars"), [*keys, ts])
    for shift, name in ((0, "_r0"), (1, "_r1")):
        side = blocks.select(*keys, F.col("_blk"), F.col("_rows").alias(name))
        found = found.withColumn("_blk", F.floor(F.col("_at") / reach) + shift).join(side, [*keys, "_blk"], "left").drop("_blk")
    empty = F.array().cast(blocks.schema["_rows"].dataType)
    both = F.concat(F.coalesce(F.col("_r0"), empty), F.coalesce(F.col("_r1"), empty))
    ahead = F.filter(both, lambda b: (b["idx"] > F.col("_at")) & (b["idx"] <= F.col("_at") + reach))
    return found.withColumn(out, ahead).drop("_at", "_r0", "_r1")
