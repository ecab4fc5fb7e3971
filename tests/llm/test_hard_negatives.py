"""Hard negatives against all pairs, and the join above a threshold against plain scores."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, tie string, score int, w long, lo int, g long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "t", 1, 2, 3, 4) for i, v, label in rows], SCHEMA)


def plain(rows, positives=5, negatives=3, every=50):
    """(anchor, positive, rank, negative, scores) by all pairs."""
    ok = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) or abs(c) * 256 > hn.LARGEST for c in v):
            continue
        ok[i, label, tuple(math.floor(256 * float(np.float32(c))) for c in v)] = True
    ok, out = list(ok), []
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    for a in ok:
        if a[0] % every:
            continue
        near = sorted((-score(a, b), b[0]) for b in ok if b is not a and b[1] == a[1])[:positives]
        far = sorted((-score(a, b), b[0]) for b in ok if b[1] != a[1])
        for p, i in near:
            found = [(s, k) for s, k in far if 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(a[0], i, r + 1, k, -p, -s) for r, (s, k) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **kw):
    got = hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, **kw)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def vectors(seed, n=900, d=20):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d)) * np.linspace(2, 0.2, d)
    x[1 : n // 3 : 2] = x[50]  # one vector in a sixth of the rows
    x[100:140] = x[60] * 0.97 + 0.01
    return [(k, v.astype(np.float32).tolist(), int(rng.integers(0, 4)) if k % 9 else 7) for k, v in enumerate(x)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 64)
    monkeypatch.setattr(hn, "QUERIES", 5)
    monkeypatch.setattr(hn, "SAMPLE", 50)


def test_against_all_pairs(spark, small_blocks):
    rows = vectors(1)
    assert mined(spark, rows) == plain(rows) and len(plain(rows)) > 50
    assert mined(spark, rows, positives=2, negatives=7) == plain(rows, 2, 7)


def test_lowered_until_full(spark, small_blocks, monkeypatch):
    """First thresholds too high for all: rounds go on until windows are full or everything was seen."""
    monkeypatch.setattr(hn, "EXPECTED", 0.02)
    monkeypatch.setattr(hn, "MORE", 4)
    rows = vectors(2, 500)
    assert mined(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = vectors(3, 200, 6)
    rows += [(1000, None, 1), (1050, [1.0] * 6, None), (None, [1.0] * 6, 1), (1100, [math.nan] * 6, 1), (1150, [math.inf] + [0.0] * 5, 1), (1200, [None] * 6, 1)]
    rows += [(1250, [], 1), (1300, [2.0, 1.0], 2), (1350, [0.0] * 6, 3), (1400, [1e9] * 6, 1), (1450, [1.0] * 6, 99), (-50, rows[3][1], 0)]
    rows += [rows[0], rows[0], rows[50]]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, []) == [] and mined(spark, [(50, [], 1), (51, [], 1)]) == []


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.integers(60_000, 65_000, 8) + rng.integers(0, 256, 8) / 256).tolist(), k % 3) for k in range(120)]
    assert mined(spark, rows) == plain(rows)


@pytest.mark.parametrize("level", [-1.0, 0.0, 0.3, 0.6, 2.0])
def test_survivors_against_plain_scores(level):
    rng = np.random.default_rng(int(10 * level) + 20)
    x, q = ((rng.normal(0, 60, (n, 40)) * np.geomspace(3, 0.2, 40)).astype(np.int32) for n in (150, 30))
    full = q.astype(np.int64) @ x.T.astype(np.int64)
    least = np.array([int(level * full.max()) + k for k in range(len(q))])
    allowed = rng.random(full.shape) < 0.7
    qi, xi, score = hn.survivors(x, q, least, allowed)
    want = {(a, b) for a, b in zip(*np.nonzero((full >= least[:, None]) & allowed), strict=True)}
    assert set(zip(qi.tolist(), xi.tolist(), strict=True)) == want and len(qi) == len(want)
    assert (score == full[qi, xi]).all()
