"""Hard negatives: for anchors and their nearest rows of the same label, the best rows of other labels in a window of scores.

Both searches are joins above a threshold. In a block of rows the dimensions with most weight come first, and a
row is indexed only by those dimensions after which its suffix norm can still bring a query of the block to
its threshold. Queries add up partial scores over the indexed dimensions, one stretch after another; a pair
goes when its partial score and the two remaining norms stay below the query's threshold. Survivors are
scored exactly from the stored rows, and a block reports for each window its best few only.

Thresholds start where a query expects to fill its window, judged from a bounded sample of SAMPLE rows, and
are lowered round by round for the queries whose windows are not full, down to the window's lower end or to
none; so the sample decides the work, never the result. Rows and queries are packed in blocks of bounded size;
a block of one meets each block of the other once, keyed by both, so neither is broadcast nor gathered.

Defined results: rows whose id, label or vector is null, or whose vector holds a component that is null, not
finite or beyond LARGEST after scaling (products would not fit a long), take no part; a shorter vector has
zeros in place of what it lacks; rows equal in id, label and vector are one row, others of one id are rows of
their own, ordered by a digest after the id; higher scores come first, ties by smaller id; an anchor without
another row of its label, or with no row in a window, gives no rows for it; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erfc, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barspark.llm.common import settle, table

SCALE, LARGEST = 256, float(1 << 24)
POSITIVES, NEGATIVES, EVERY = 5, 3, 50
#: Window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows and queries in a block, rows looked at to choose thresholds, dimensions added up between two prunings.
BLOCK, QUERIES, SAMPLE, STRETCH = 4096, 1024, 2048, 16
#: Rows a window expects at its first threshold, for each it needs, and how many times as many each round after.
EXPECTED, MORE = 6, 16
#: Share of pairs alive at which exact scores cost less than more partial ones.
FEW = 0.02
NONE, ALL = -(1 << 62), 1 << 62


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, tie, label, v) of the rows that take part, once each."""

    def fits(c: Column) -> Column:
        return F.coalesce(~F.isnan(c) & (F.abs(c) <= LARGEST), F.lit(False))

    scaled = F.transform("embedding", lambda c: c.cast("double") * SCALE)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null").filter(F.forall("v", fits))
    rows = rows.select("vec_id", "label", F.transform("v", lambda c: F.floor(c).cast("int")).alias("v")).distinct()
    return rows.select("vec_id", F.xxhash64("label", "v").alias("tie"), "label", "v")


def matrix(vectors: list[np.ndarray], d: int) -> np.ndarray:
    out = np.zeros((len(vectors), d), np.int32)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def packed_rows(rows: DataFrame, d: int) -> DataFrame:
    """Blocks of at most BLOCK rows, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                own = batch.iloc[a : a + BLOCK]
                longs = np.stack([own[c].to_numpy(np.int64) for c in ("vec_id", "tie", "label")])
                yield pd.DataFrame({"b": [(part << 24) + seq], "longs": [longs.tobytes()], "v": [matrix(own["v"].tolist(), d).tobytes()]})
                seq += 1

    return rows.mapInPandas(run, "b long, longs binary, v binary")


def packed_queries(queries: DataFrame, d: int) -> DataFrame:
    """One block for each partition: g, its longs (vec_id, tie, label), vectors, and windows (place, window, least, most)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches))  # QUERIES rows or so
        if len(own):
            sizes = [len(w) for w in own["w"]]
            longs = np.stack([own[c].to_numpy(np.int64) for c in ("vec_id", "tie", "label")])
            windows = np.stack([np.repeat(np.arange(len(own)), sizes), *(np.concatenate(own[c].tolist()).astype(np.int64) for c in ("w", "least", "hi"))])
            yield pd.DataFrame({"g": [TaskContext.get().partitionId()], "longs": [longs.tobytes()], "v": [matrix(own["v"].tolist(), d).tobytes()], "windows": [windows.tobytes()]})

    return queries.mapInPandas(run, "g long, longs binary, v binary, windows binary")


def upto(n: int) -> Column:
    """A row for each of 0 to n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def survivors(x: np.ndarray, q: np.ndarray, least: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, rows and exact scores of all allowed pairs that reach the query's threshold."""
    n, d = x.shape
    order = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    xf, qf = x[:, order].astype(np.float64), q[:, order].astype(np.float64)

    def suffix_norms(a: np.ndarray) -> np.ndarray:
        back = np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1]
        return np.hstack((np.sqrt(back), np.zeros((len(a), 1))))

    xs, qs = suffix_norms(xf), suffix_norms(qf)
    floor = least - 1e-6 * (1 + qs[:, 0] * xs[:, 0].max(initial=0))  # more than rounding can take away
    # Dimensions a row is indexed by: those after which it may still reach some threshold with what follows.
    indexed = (xs[:, :d] * qs[:, 0].max(initial=0) >= floor.min(initial=0)).sum(axis=1)
    by = np.argsort(-indexed, kind="stable")
    xf, xs, indexed = xf[by], xs[by], indexed[by]
    score = np.zeros((len(q), n))
    alive = np.ones((len(q), n), bool)
    for s in range(0, d, STRETCH):
        e = min(s + STRETCH, d)
        k = int((indexed > s).sum())  # the posting lists of these dimensions are the first k rows
        if k:
            score[:, :k] += qf[:, s:e] @ np.where(np.arange(s, e) < indexed[:k, None], xf[:k, s:e], 0).T
        if 2 * e >= d:
            upto = np.minimum(indexed, e)
            alive = score + qs[:, upto] * xs[np.arange(n), upto] >= floor[:, None]
            if alive.mean() < FEW or not k:
                break
    qi, xi = np.nonzero(alive & allowed[:, by])
    xi = by[xi]
    exact = np.empty(len(qi), np.int64)
    for a in range(0, len(qi), 1 << 16):
        exact[a : a + (1 << 16)] = np.einsum("ij,ij->i", q[qi[a : a + (1 << 16)]].astype(np.int64), x[xi[a : a + (1 << 16)]].astype(np.int64))
    keep = exact >= least[qi]
    return qi[keep], xi[keep], exact[keep]


def search(blocks: DataFrame, salts: int, queries: DataFrame, n_queries: int, d: int, same: bool, k: int) -> DataFrame:
    """(vec_id, tie, w, id, other, score): the best k rows of each block in each window, all with the query's label or all without."""
    spark = blocks.sparkSession
    groups = max(1, ceil(n_queries / QUERIES))
    tasks = min(salts * groups, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = blocks.select(F.pmod(F.xxhash64("b"), F.lit(salts)).alias("s"), upto(groups).alias("g"), "longs", "v")
    right = packed_queries(queries.repartition(groups), d).withColumn("s", upto(salts))

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: np.empty(0, np.int64) for c in ("vec_id", "tie", "w", "id", "other", "score")})]
        for q_longs, q_v, q_windows in zip(asked["longs"], asked["v"], asked["windows"], strict=True):
            q_longs, q_v = np.frombuffer(q_longs, np.int64).reshape(3, -1), np.frombuffer(q_v, np.int32).reshape(-1, d)
            windows = np.frombuffer(q_windows, np.int64).reshape(4, -1)
            for x_longs, x_v in zip(rows["longs"], rows["v"], strict=True):
                x_longs, x_v = np.frombuffer(x_longs, np.int64).reshape(3, -1), np.frombuffer(x_v, np.int32).reshape(-1, d)
                for a in range(0, q_longs.shape[1], 256):
                    mine = windows[:, (windows[0] >= a) & (windows[0] < a + 256)]
                    out.append(best_of(q_longs[:, a : a + 256], q_v[a : a + 256], mine - np.array([[a], [0], [0], [0]]), x_longs, x_v, same, k))
        return pd.concat(out)

    left, right = left.repartition(tasks, "s", "g"), right.repartition(tasks, "s", "g")
    pairs = left.groupBy("s", "g").cogroup(right.groupBy("s", "g"))
    return pairs.applyInPandas(meet, "vec_id long, tie long, w int, id long, other long, score long")


def best_of(q_longs, q_v, windows, x_longs, x_v, same: bool, k: int) -> pd.DataFrame:
    """The best k rows of a block in each window of some queries."""
    least = np.full(q_longs.shape[1], ALL, np.int64)
    np.minimum.at(least, windows[0], windows[2])
    alike = q_longs[2][:, None] == x_longs[2]
    itself = (q_longs[0][:, None] == x_longs[0]) & (q_longs[1][:, None] == x_longs[1])
    qi, xi, score = survivors(x_v, q_v, least, alike & ~itself if same else ~alike)
    rank = np.lexsort((x_longs[1][xi], x_longs[0][xi], -score, qi))
    qi, xi, score = qi[rank], xi[rank], score[rank]
    begin = np.searchsorted(qi, np.arange(q_longs.shape[1] + 1))
    found = []
    for at, w, low, high in windows.T.tolist():
        a, b = begin[at], begin[at + 1]
        # Scores fall from a to b: the window is one stretch of them.
        a += int(np.searchsorted(-score[a:b], -high))
        b = min(a + k, begin[at] + int(np.searchsorted(-score[begin[at] : b], -low, side="right")))
        if b > a:
            found.append(np.stack((np.full(b - a, q_longs[0][at]), np.full(b - a, q_longs[1][at]), np.full(b - a, w), x_longs[0][xi[a:b]], x_longs[1][xi[a:b]], score[a:b]), axis=1))
    return pd.DataFrame(np.concatenate(found) if found else np.empty((0, 6), np.int64), columns=["vec_id", "tie", "w", "id", "other", "score"])


def thresholds(queries: DataFrame, sample: np.ndarray, expected: float) -> DataFrame:
    """Add least: for each window the score above which the sample lets expect so many rows, or its lower end."""
    d = sample.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            scores = matrix(batch["v"].tolist(), d).astype(np.float64) @ sample.T.astype(np.float64)
            mean, spread = scores.mean(axis=1).tolist(), scores.std(axis=1).tolist()
            least = []
            for mu, sigma, n, lows, highs in zip(mean, spread, batch["population"].tolist(), batch["lo"], batch["hi"], strict=True):
                own = []
                for lo, hi in zip(lows.tolist(), highs.tolist(), strict=True):
                    tail = 0.0 if hi >= ALL or not sigma else erfc((hi - mu) / (sigma * sqrt(2))) / 2
                    share = tail + expected / max(n, 1)
                    own.append(max(lo, int(mu - sigma * NormalDist().inv_cdf(share))) if sigma and share < 0.5 else lo)
                least.append(own)
            yield batch.assign(least=least)

    return queries.mapInPandas(run, f"{queries.schema.simpleString()[len('struct<') : -1]}, least: array<bigint>")


def fill(blocks: DataFrame, salts: int, queries: DataFrame, sample: np.ndarray, same: bool, k: int) -> DataFrame:
    """(vec_id, tie, w, rank, id, other, score): the best k rows of every window.

    queries: vec_id, tie, label, v, population (rows that may match), and arrays w, lo, hi of windows.
    """
    spark, d = blocks.sparkSession, sample.shape[1]
    most = queries.agg(F.max("population")).first()[0] or 0
    expected, results = float(EXPECTED * k), []
    while True:
        n = queries.count()
        if not n:
            break
        asked = settle(thresholds(queries, sample, expected if expected < most else float(2 * most)), "negatives-asked")
        found = search(blocks, salts, asked, n, d, same, k)
        order = Window.partitionBy("vec_id", "tie", "w").orderBy(F.desc("score"), "id", "other")
        found = settle(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "negatives-found")
        full = found.filter(F.col("rank") == k).select(F.col("vec_id").alias("_i"), F.col("tie").alias("_t"), F.col("w").alias("_w"))
        each = asked.select("vec_id", "tie", F.explode(F.arrays_zip("w", "lo", "hi", "least")).alias("z")).select("vec_id", "tie", "z.*").filter("least > lo")
        missing = settle(each.join(full, (F.col("vec_id") == F.col("_i")) & (F.col("tie") == F.col("_t")) & (F.col("w") == F.col("_w")), "left_anti"), "negatives-open")
        key = missing.select(F.col("vec_id").alias("_i"), F.col("tie").alias("_t"), F.col("w").alias("_w"))
        results.append(found.join(key, (F.col("vec_id") == F.col("_i")) & (F.col("tie") == F.col("_t")) & (F.col("w") == F.col("_w")), "left_anti"))
        again = missing.groupBy(F.col("vec_id").alias("_i"), F.col("tie").alias("_t")).agg(F.sort_array(F.collect_list(F.struct("w", "lo", "hi"))).alias("z"))
        again = queries.drop("w", "lo", "hi").join(again, (F.col("vec_id") == F.col("_i")) & (F.col("tie") == F.col("_t"))).drop("_i", "_t")
        queries = again.select("*", *(F.col(f"z.{c}").alias(c) for c in ("w", "lo", "hi"))).drop("z")
        expected *= MORE
    if not results:
        return spark.createDataFrame([], "vec_id long, tie long, w int, id long, other long, score long, rank int")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that anchors selects."""
    spark = vectors.sparkSession
    rows = settle(whole_numbers(vectors), "negatives-rows")
    n, d = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n or not d:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # About SAMPLE rows by digest, whatever the table.
    picked = rows.filter(F.pmod(F.xxhash64("tie", "vec_id"), F.lit(n)) < SAMPLE).limit(2 * SAMPLE).select("v").collect()
    sample = matrix([np.array(r["v"], np.int32) for r in picked], d) if picked else np.zeros((1, d), np.int32)
    blocks = settle(packed_rows(rows, d), "negatives-blocks")
    salts = max(1, ceil(n / BLOCK))
    labels = rows.groupBy(F.col("label").alias("_label")).agg(F.count(F.lit(1)).alias("alike"))
    base = settle(rows.filter(anchors).join(labels, F.col("label") == F.col("_label")).drop("_label"), "negatives-anchors")

    whole = (F.array(F.lit(0)).alias("w"), F.array(F.lit(NONE)).alias("lo"), F.array(F.lit(ALL)).alias("hi"))
    near = fill(blocks, salts, base.select("vec_id", "tie", "label", "v", F.col("alike").alias("population"), *whole), sample, True, positives)
    near = settle(near.drop("w").withColumnRenamed("rank", "w"), "negatives-positives")

    lo, hi = (F.expr(f"(score div 100) * {share} + ((score % 100) * {share} + {up}) div 100") for share, up in ((LOW, 99), (HIGH, 0)))
    windows = near.filter("score >= 0").select(F.col("vec_id").alias("_i"), F.col("tie").alias("_t"), F.struct("w", lo.alias("lo"), hi.alias("hi")).alias("z"))
    windows = windows.filter("z.lo <= z.hi").groupBy("_i", "_t").agg(F.sort_array(F.collect_list("z")).alias("z"))
    asked = base.join(windows, (F.col("vec_id") == F.col("_i")) & (F.col("tie") == F.col("_t")))
    asked = asked.select("vec_id", "tie", "label", "v", (F.lit(n) - F.col("alike")).alias("population"), *(F.col(f"z.{c}").alias(c) for c in ("w", "lo", "hi")))
    far = fill(blocks, salts, asked, sample, False, negatives)

    near = near.select(F.col("vec_id").alias("_i"), F.col("tie").alias("_t"), F.col("w").alias("_w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(near, (F.col("vec_id") == F.col("_i")) & (F.col("tie") == F.col("_t")) & (F.col("w") == F.col("_w")))
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % EVERY == 0)


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike, list_dot_product(a.v, r.v)::BIGINT AS score
      FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id))::INTEGER AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""
