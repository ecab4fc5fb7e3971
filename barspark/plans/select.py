"""Exact quantiles of all positions of a vector column, by refining histograms of fixed size.

A double maps to 64 bits in the same order. Each pass counts, per position and wanted rank, the next eight bits of
the values that share the bits found so far; the counts of a position meet as one block of fixed size per task,
and the task that adds them up also picks the bin that holds the rank. Eight passes give the bits of each wanted
value. No value is moved: what is shuffled grows with positions and tasks, not with rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = np.uint64(1 << 63)
STEP, BINS = 8, 256
#: Values looked at together.
AT_ONCE = 1 << 20


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits & TOP, ~bits, bits | TOP)


def from_bits(bits: np.ndarray) -> np.ndarray:
    return np.where(bits & TOP, bits & ~TOP, ~bits).view(np.float64)


def vector_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> np.ndarray:
    """Linearly interpolated quantiles, one row per position and one column per probability.

    Null entries, NaN, and entries that a shorter vector lacks are left out; a position without a value is NaN. The
    rows are read nine times and should be a written table. What is kept per position is of fixed size.
    """
    data = df.where(F.col(col).isNotNull()).select(F.col(col).alias("v"))
    width = data.agg(F.max(F.size("v"))).first()[0] or 0
    slots = 2 * len(probs)
    prefix = np.zeros((width, slots), np.uint64)
    rank = np.full((width, slots), -1, np.int64)  # -1 until the number of values is known
    share = np.zeros((width, len(probs)))

    def matrix(rows: Sequence) -> np.ndarray:
        out = np.full((len(rows), width), np.nan)
        for k, v in enumerate(rows):
            out[k, : len(v)] = v
        return out

    for shift in range(64 - STEP, -1, -STEP):
        # Ranks that share all bits so far share their counts as well.
        same = np.zeros((width, slots), np.int64)
        for s in range(slots):
            for earlier in range(s, -1, -1):
                same[:, s] = np.where(prefix[:, earlier] == prefix[:, s], earlier, same[:, s])
        lead = np.flatnonzero((same == np.arange(slots)).any(axis=0))

        def count(batches: Iterator[pd.DataFrame], shift=shift, prefix=prefix, same=same, lead=lead) -> Iterator[pd.DataFrame]:
            total = np.zeros((slots, width * BINS), np.int64)
            for batch in batches:
                step = max(1, AT_ONCE // max(width, 1))
                for a in range(0, len(batch), step):
                    x = matrix(batch["v"].iloc[a : a + step].tolist())
                    there = ~np.isnan(x)
                    bits = ordered_bits(x)
                    at = np.arange(width) * BINS + ((bits >> np.uint64(shift)) & np.uint64(BINS - 1)).astype(np.int64)
                    for s in lead.tolist():
                        mine = there & (same[:, s] == s)
                        if shift + STEP < 64:
                            mine &= (bits >> np.uint64(shift + STEP)) == prefix[:, s]
                        total[s] += np.bincount(at[mine], minlength=width * BINS)
            blocks = total.reshape(slots, width, BINS).transpose(1, 0, 2)
            some = np.flatnonzero(blocks.any(axis=(1, 2)))
            yield pd.DataFrame({"pos": some, "counts": [blocks[k].tobytes() for k in some]})

        def pick(batches: Iterator[pd.DataFrame], rank=rank, same=same) -> Iterator[pd.DataFrame]:
            at, total = None, None

            def chosen() -> pd.DataFrame:
                counts, ranks, n = total[same[at]], rank[at].copy(), int(total[0].sum())
                if (ranks < 0).any():
                    places = np.asarray(probs) * (n - 1)
                    ranks = np.stack((np.floor(places), np.ceil(places)), axis=1).astype(np.int64).ravel()
                upto = counts.cumsum(axis=1)
                bins = (upto <= ranks[:, None]).sum(axis=1)
                below = np.where(bins > 0, upto[np.arange(slots), np.maximum(bins - 1, 0)], 0)
                return pd.DataFrame({"pos": [at], "n": [n], "bins": [bins.tolist()], "ranks": [(ranks - below).tolist()]})

            for batch in batches:
                for pos, counts in zip(batch["pos"].tolist(), batch["counts"], strict=True):
                    if pos != at:
                        if at is not None:
                            yield chosen()
                        at, total = pos, np.zeros((slots, BINS), np.int64)
                    total += np.frombuffer(counts, np.int64).reshape(slots, BINS)
            if at is not None:
                yield chosen()

        counted = data.mapInPandas(count, "pos long, counts binary").repartition("pos").sortWithinPartitions("pos")
        first, prefix, rank = shift + STEP == 64, prefix.copy(), rank.copy()
        for r in counted.mapInPandas(pick, "pos long, n long, bins array<long>, ranks array<long>").collect():
            prefix[r["pos"]] = (prefix[r["pos"]] << np.uint64(STEP)) | np.array(r["bins"], np.uint64)
            rank[r["pos"]] = r["ranks"]
            if first:
                share[r["pos"]] = np.asarray(probs) * (r["n"] - 1) % 1
    values = from_bits(prefix)
    low, high = values[:, 0::2], values[:, 1::2]
    return np.where(rank[:, ::2] < 0, np.nan, low + (high - low) * share)
