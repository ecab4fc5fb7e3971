"""Shards of nearly equal bytes by Karmarkar-Karp differencing; equal texts stay together.

A group is all rows of one text, and cannot be divided. Every group begins as a partial partition: its bytes
in one part, nothing in the others. Differencing takes the two partial partitions of largest spread again
and again and adds them in opposite order, largest to smallest, so their differences cancel.

Groups are dealt into blocks of about BLOCK, and each block is differenced in a task of its own. A block's
result is again one partial partition of as many parts; blocks are differenced level by level in the same
way until one partition is left. Each level writes which part of a block goes to which part above.

Defined results: a null text is an empty one and in one group with it; repeated rows are rows of their own in
their text's group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm.common import settle, table, text_or_empty

SHARDS = 24
OVERHEAD = 8
#: Partial partitions that one task differences.
BLOCK = 4096


def difference(loads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of part loads) to one: its loads, and per row where each part goes."""
    n, parts = loads.shape
    sums: list[np.ndarray | None] = list(loads)
    made: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    heap = [(int(s.min() - s.max()), i) for i, s in enumerate(loads)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        down, up = np.argsort(-sums[a], kind="stable"), np.argsort(sums[b], kind="stable")
        total = sums[a][down] + sums[b][up]
        to_a, to_b = np.empty(parts, np.int64), np.empty(parts, np.int64)
        to_a[down] = to_b[up] = np.arange(parts)
        made.append((a, b, to_a, to_b))
        sums[a] = sums[b] = None
        sums.append(total)
        heapq.heappush(heap, (int(total.min() - total.max()), len(sums) - 1))
    to: list[np.ndarray | None] = [None] * len(sums)
    to[-1] = np.arange(parts)
    for i in range(len(made) - 1, -1, -1):
        a, b, to_a, to_b = made[i]
        to[a], to[b] = to[n + i][to_a], to[n + i][to_b]
    return sums[-1], np.array(to[:n])


def _level(items: DataFrame, parts: int) -> DataFrame:
    """Difference items (item, part, load; parts without load may be missing) block by block (block)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(rows["item"].to_numpy(), return_inverse=True)
        loads = np.zeros((len(names), parts), np.int64)
        np.add.at(loads, (code, rows["part"].to_numpy()), rows["load"].to_numpy())
        # The same order of items gives the same result whatever order the rows come in.
        total, to = difference(loads)
        return pd.DataFrame(
            {
                "block": rows["block"].iloc[0],
                "item": np.append(np.repeat(names, parts), np.full(parts, "")),
                "part": np.append(np.tile(np.arange(parts), len(names)), np.arange(parts)),
                "to": np.append(to.ravel(), np.arange(parts)),
                "load": np.append(np.zeros(len(names) * parts, np.int64), total),
            }
        )

    return items.groupBy("block").applyInPandas(run, "block long, item string, part long, to long, load long")


def byte_shards(groups: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """(item, shard) for groups (item string, load long); loads of the shards are nearly equal."""
    items = groups.select("item", F.lit(0).cast("long").alias("part"), "load")
    n, placed = groups.count(), None
    while True:
        blocks = max(1, math.ceil(n / block))
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        level = _level(dealt, shards)
        if placed is None:
            level = level.filter("item = '' or part = 0")  # groups lie in their first part
        level = settle(level, "shard-level")
        moves = level.filter("item <> ''").select(F.col("item").alias("_item"), F.col("part").alias("_part"), F.col("to"), F.col("block").cast("string").alias("up"))
        if placed is None:
            placed = moves.select(F.col("_item").alias("item"), "up", F.col("to").alias("part"))
        else:
            placed = placed.join(moves, (placed["up"] == moves["_item"]) & (placed["part"] == moves["_part"]))
            placed = placed.select("item", moves["up"], moves["to"].alias("part"))
        if blocks == 1:
            return placed.select("item", F.col("part").cast("int").alias("shard"))
        items, n = level.filter("item = ''").select(F.col("block").cast("string").alias("item"), "part", "load"), blocks


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add slot, gapless from 0 in each shard, ranked in two levels over about sqrt(rows) cells."""
    cells = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    counts = rows.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_cell")) - F.col("_n")
    counts = counts.select(F.col("shard").alias("_shard"), F.col("_cell").alias("_at"), before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy(*order)) - 1
    ranked = rows.withColumn("_rank", rank).join(counts, (F.col("shard") == F.col("_shard")) & (F.col("_cell") == F.col("_at")))
    return ranked.withColumn("slot", F.col("_rank") + F.col("_before")).drop("_cell", "_rank", "_shard", "_at", "_before")


def shard_documents(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """One row per document: size, text_crc32, law, shard, slot, grown_shard, and text_md5 (its group)."""
    text = text_or_empty()
    rows = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_md5")
    )
    rows = settle(rows, "shard-rows")
    groups = settle(rows.groupBy(F.col("text_md5").alias("item")).agg(F.sum("size").alias("load")), "shard-groups")
    placed = byte_shards(groups, shards, block).withColumnRenamed("item", "_item")
    rows = settle(rows.join(placed, F.col("text_md5") == F.col("_item")).drop("_item"), "shard-placed")
    return with_slots(rows, ["doc_id", "text_md5"]).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
