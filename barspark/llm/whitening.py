"""Whitening of embeddings along the leading components of their exact covariance.

Entries become whole numbers, so the scatter of the fit list (n times the sum of products less the product of
sums) is a matrix of whole numbers. Tasks sum products exactly and send them in parts of 32 bits; only this
matrix, of the square of the number of dimensions, reaches the driver. Its characteristic polynomial, the
roots and the null spaces at them come from exact_spectrum. Rows are then projected where they lie.

The fit list is every distinct vector once, so copies, however many, weigh as one; they meet in a partial
aggregate. It is written once and read for the scatter and for the check of the whitened covariance.

Defined results: rows whose vector is null, empty, or holds an entry that is null, not finite or beyond LARGEST
(whose whole number would not fit) are dropped; of vectors of different lengths those of the commonest length
(the shorter, if two are as common) take part and the others are dropped; a component needs a positive
eigenvalue, so there are fewer rows where the fit list spans fewer dimensions and none where it holds one
vector; deviations beyond a long are null; a null vec_id stays null; repeated rows get an answer each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import settle, table
from barspark.llm.exact_spectrum import spectrum

STEP, SHIFT, COMPONENTS = 64, 1_000_000, 16
LARGEST = float(1 << 55)
#: Parts of 32 bits in which sums travel; the last has the sign.
LIMBS = 5


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, y): the whole numbers of each vector that takes part, less SHIFT, which covariances do not see."""

    def fits(c: Column) -> Column:
        return F.coalesce(~F.isnan(c) & (F.abs(c) <= LARGEST), F.lit(False))

    entries = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("entries"))
    rows = rows.filter(F.col("entries").isNotNull() & (F.size("entries") > 0) & F.forall("entries", fits))
    lengths = rows.groupBy(F.size("entries").alias("length")).count().orderBy(F.desc("count"), "length").first()
    rows = rows.filter(F.size("entries") == (lengths["length"] if lengths else 0))
    return rows.select("vec_id", F.transform("entries", lambda c: F.floor(c * STEP)).alias("y"))


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def products(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of columns, as Python numbers."""
    peak = int(np.abs(y).max(initial=0))
    if peak * peak * len(y) < 1 << 53:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def limbs(value: int) -> list[int]:
    low = [(value >> (32 * k)) & 0xFFFFFFFF for k in range(LIMBS - 1)]
    return [*low, value >> (32 * (LIMBS - 1))]


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors, sums per dimension, and n times the sums of products less the products of sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                y = matrix_of(batch.column("y"))
                n += len(y)
                sums = sums + y.astype(object).sum(axis=0)
                squares = squares + products(y)
        if n:
            d = len(sums)
            cells = [(-1, -1, n), *((-1, j, sums[j]) for j in range(d)), *((i, j, squares[i, j]) for i in range(d) for j in range(i, d))]
            i, j, v = zip(*cells, strict=True)
            parts = list(zip(*(limbs(int(x)) for x in v), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (i, j, *parts)], names=["i", "j", *names])

    names = [f"l{k}" for k in range(LIMBS)]
    cells = fit.mapInArrow(partial, ", ".join(f"{c} long" for c in ("i", "j", *names)))
    found = {(r["i"], r["j"]): sum(r[c] << (32 * k) for k, c in enumerate(names)) for r in cells.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names)).collect()}
    n = found.pop((-1, -1), 0)
    d = sum(i < 0 for i, _ in found)
    sums = [found[-1, j] for j in range(d)]
    return n, sums, [[n * found[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n times y less the sums, exact: whole numbers of 64 bits where all squares fit, Python numbers elsewhere."""
    peak = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums), default=0)
    if peak * peak * len(sums) < 1 << 62:
        return y * n - np.array(sums, np.int64)
    return y.astype(object) * n - np.array(sums, dtype=object)


def whitened_gap(fit: DataFrame, n: int, sums: list[int], weights: np.ndarray) -> float:
    """Largest entry of the whitened fit list's covariance less the identity."""
    k = len(weights)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = centred(matrix_of(batch.column("y")), n, sums).astype(np.float64) @ weights.T
                total += np.vstack((w.sum(axis=0), w.T @ w))
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], names=["i", "j", "v"])

    total = np.zeros((k + 1, k))
    for r in fit.mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"] / n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and component."""
    rows = whole_numbers(vectors)
    fit = settle(rows.select("y").distinct(), "whiten-fit")
    n, sums, matrix = scatter(fit)
    values, vectors_of = spectrum(matrix, components)
    weights = vectors_of / np.sqrt(np.array(values))[:, None] if values else np.empty((0, len(sums)))
    share = np.array(values) / max(sum(matrix[i][i] for i in range(len(matrix))), 1)
    gap = whitened_gap(fit, n, sums, weights) if values else 0.0
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m or not k:
                continue
            z = centred(matrix_of(batch.column("y")), n, sums)
            far = [x if x < 1 << 63 else None for x in (z * z).sum(axis=1).tolist()]
            again = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(far, pa.int64()).take(again),
                    pa.array((z.astype(np.float64) @ weights.T).ravel()),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, gap)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
