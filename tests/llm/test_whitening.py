"""Whitening against a plain eigendecomposition, and the exact spectrum against made matrices."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from barspark.llm import exact_spectrum as es
from barspark.llm import whitening as wh

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, y string, n string, entries long, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "y", "n", 2, 3) for i, v in rows], SCHEMA)


def plain(rows):
    """Kept rows, their whole numbers, and sums and covariance of the distinct ones, in Python numbers."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in kept]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    sums = [sum(f[j] for f in fit) for j in range(d)]
    cov = [[float(sum((Fraction(f[i]) - Fraction(sums[i], n)) * (f[j] - Fraction(sums[j], n)) for f in fit) / n) for j in range(d)] for i in range(d)]
    return kept, x, n, sums, np.array(cov)


def check(got, rows, components=wh.COMPONENTS):
    kept, x, n, sums, cov = plain(rows)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == k * len(kept)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    sign = np.zeros(k)
    for (i, _), xs in zip(kept, x, strict=True):
        far = sum((n * a - s) ** 2 for a, s in zip(xs, sums, strict=True))
        centre = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(xs, sums, strict=True)])
        for c in range(k):
            want = centre @ v[:, c] / math.sqrt(e[c])
            r = next(r for r in by[i, c + 1] if r["deviation"] == far)
            assert r["n"] == n and abs(r["explained"] / (e[c] / np.trace(cov)) - 1) < 1e-9 and r["identity_error"] < 1e-9
            if abs(want) > 1e-6 and not sign[c]:
                sign[c] = np.sign(want * r["whitened"])
            assert abs(sign[c] * r["whitened"] - want) < 1e-7 or abs(want) <= 1e-6


def odd(seed, n=60, d=7):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(0, [3, 2, 1, 0.5, 0.4, 0.2, 0.1][:d]).tolist()) for k in range(n)]
    rows += [(100 + k, rows[0][1]) for k in range(40)]  # one vector very often
    rows += [(200, None), (201, []), (202, [None] + [0.0] * (d - 1)), (203, [math.nan] + [0.0] * (d - 1)), (204, [math.inf] + [0.0] * (d - 1)), (205, [-0.0] * d)]
    return rows + [(None, rows[3][1]), rows[5]]


def test_against_plain_eigenvectors(spark):
    rows = odd(1)
    check(wh.whiten(frame(spark, rows)).collect(), rows)
    check(wh.whiten(frame(spark, rows).repartition(7), components=3).collect(), rows, 3)


def test_given_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(80).collect()]
    vectors = frame(spark, rows)
    check(wh.whiten(vectors).collect(), rows)


def test_other_lengths_and_too_large(spark):
    rows = odd(2)
    got = wh.whiten(frame(spark, rows + [(300, [1.0, 2.0]), (301, [1e30] * 7)])).collect()
    check(got, rows)


def test_few_and_no_dimensions(spark):
    assert wh.whiten(frame(spark, [])).count() == 0
    assert wh.whiten(frame(spark, [(1, None)])).count() == 0
    assert wh.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).count() == 0
    got = wh.whiten(frame(spark, [(1, [0.5, 1.0]), (2, [1.5, 3.0]), (3, [0.0, 0.0])])).collect()  # on one line
    assert {r["component"] for r in got} == {1} and len(got) == 3 and all(abs(r["explained"] - 1) < 1e-12 for r in got)


def test_large_entries_stay_exact(spark):
    rows = [(k, [float((1 << 40) + k * (1 << 30)), float(k * k)]) for k in range(9)]
    got = wh.whiten(frame(spark, rows)).filter("component = 1").collect()
    _, x, n, sums, _ = plain(rows)
    for r in got:
        far = sum((n * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))
        assert r["deviation"] == (far if far < 1 << 63 else None)
    assert got[0]["identity_error"] < 1e-6


def plain_polynomial(m):
    """Faddeev-LeVerrier in fractions."""
    d = len(m)
    c, b = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        b = [[sum(m[i][t] * b[t][j] for t in range(d)) + c[-1] * (i == j) for j in range(d)] for i in range(d)]
        ab = [sum(m[i][t] * b[t][i] for t in range(d)) for i in range(d)]
        c.append(-sum(ab) / k)
    return [int(x) for x in reversed(c)]


@pytest.mark.parametrize("seed", range(4))
def test_polynomial_against_plain(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-9, 9, (6 + seed, 2 + 2 * seed)).astype(object)
    if seed == 2:
        x[:, 1] = x[:, 0]
    m = [[int(v) for v in row] for row in x.T @ x * 10**seed]
    assert es.characteristic(m) == plain_polynomial(m)


def test_repeated_and_near_roots():
    m = [[2, 1, 0, 0], [1, 2, 0, 0], [0, 0, 3, 0], [0, 0, 0, 1]]  # 3, 3, 1, 1
    values, vectors = es.spectrum(m, 4)
    assert np.allclose(values, [3, 3, 1, 1], atol=1e-15)
    assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-15) and np.allclose(np.array(m) @ vectors.T, vectors.T * values, atol=1e-15)
    big = 10**20
    values, vectors = es.spectrum([[big, 1], [1, big]], 2)  # two roots that doubles cannot tell apart
    assert np.allclose(np.abs(vectors), math.sqrt(0.5), atol=1e-15) and abs(vectors[0] @ vectors[1]) < 1e-15
    assert len(es.spectrum([[0, 0], [0, 0]], 2)[0]) == 0
