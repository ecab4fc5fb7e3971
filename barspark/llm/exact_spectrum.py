"""Eigenvalues and eigenvectors of a symmetric integer matrix with no negative eigenvalue, from its exact characteristic polynomial.

The polynomial is computed modulo many primes by reduction to Hessenberg form (all primes side by side) and put
together by Chinese remaindering. Its roots are all real, so the sign changes of the polynomial moved to x
count the roots above x, with multiplicity; bisection on that count isolates them, and on the sign of the
polynomial refines them, in whole numbers at a binary scale. Components are the null space at a root, by
inverse iteration in fixed-point numbers far beyond double precision.

The matrix is small: its side is the number of dimensions of a vector, whatever the number of rows.
"""

from __future__ import annotations

from math import comb, isqrt

import numpy as np

#: Bits that a root is known to beyond the scale of the matrix, and of the fixed-point numbers beyond these.
ROOT_BITS, GUARD = 120, 64


def primes(n: int, below: int = (1 << 31) - 1) -> list[int]:
    """The n largest odd primes up to a bound under 2 ** 32, by Miller-Rabin with bases that decide it there."""
    found, p = [], below | 1

    def prime(p: int) -> bool:
        if p < 9:
            return p in (3, 5, 7)
        d, s = p - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        for a in (2, 3, 5, 7):
            x = pow(a, d, p)
            if x in (1, p - 1):
                continue
            for _ in range(s - 1):
                x = x * x % p
                if x == p - 1:
                    break
            else:
                return False
        return True

    while len(found) < n:
        if prime(p):
            found.append(p)
        p -= 2
    return found


def hessenberg(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Matrices (prime x row x column), each modulo its prime, in upper Hessenberg form of the same polynomial."""
    count, d, _ = h.shape
    each, mod = np.arange(count), p[:, None]
    for k in range(d - 2):
        below = h[:, k + 1 :, k] != 0
        pivot = k + 1 + below.argmax(axis=1)  # the first that is not zero; the next row itself where all are
        rows = h[each, k + 1].copy()
        h[each, k + 1], h[each, pivot] = h[each, pivot], rows
        cols = h[each, :, k + 1].copy()
        h[each, :, k + 1] = h[each, :, pivot]
        h[each, :, pivot] = cols
        lead = h[:, k + 1, k].tolist()
        inverse = np.array([pow(x, -1, q) if x else 0 for x, q in zip(lead, p.tolist(), strict=True)], np.int64)
        times = h[:, k + 2 :, k] * inverse[:, None] % mod
        h[:, k + 2 :, k:] = (h[:, k + 2 :, k:] - times[:, :, None] * h[:, None, k + 1, k:] % mod[:, :, None]) % mod[:, :, None]
        back = (h[:, :, k + 2 :] * times[:, None, :] % mod[:, :, None]).sum(axis=2)
        h[:, :, k + 1] = (h[:, :, k + 1] + back) % mod
    return h


def polynomials(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients (prime x power) of the characteristic polynomials of Hessenberg matrices."""
    count, d, _ = h.shape
    mod = p[:, None]
    polys = np.zeros((count, d + 1, d + 1), np.int64)
    polys[:, 0, 0] = 1
    below = np.zeros((count, d), np.int64)  # products of the entries under the diagonal, from i to k
    for k in range(d):
        if k:
            below[:, :k] = below[:, :k] * h[:, k, k - 1, None] % mod
            below[:, k - 1] = h[:, k, k - 1]
        up = polys[:, k]
        new = np.zeros((count, d + 1), np.int64)
        new[:, 1:] = up[:, :-1]
        new = new - up * h[:, k, k, None] % mod
        if k:
            weight = h[:, :k, k] * below[:, :k] % mod
            new = new - (weight[:, :, None] * polys[:, :k] % mod[:, :, None]).sum(axis=1)
        polys[:, k + 1] = new % mod
    return polys[:, d]


def characteristic(matrix: list[list[int]]) -> list[int]:
    """Coefficients, constant first, of the characteristic polynomial of a symmetric matrix with no negative eigenvalue."""
    d = len(matrix)
    trace = sum(matrix[k][k] for k in range(d))
    # The k-th coefficient is a sum of products of k roots; for given sum of roots it is largest when all are equal.
    bound = 2 * max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1)) + 1
    used = primes(bound.bit_length() // 30 + 1)
    p = np.array(used, np.int64)
    h = np.array([[[x % q for x in row] for row in matrix] for q in used], np.int64)
    found = polynomials(hessenberg(h, p), p)
    whole = 1
    for q in used:
        whole *= q
    parts = [whole // q * pow(whole // q, -1, q) for q in used]
    out = []
    for k in range(d + 1):
        c = sum(int(r) * part for r, part in zip(found[:, k].tolist(), parts, strict=True)) % whole
        out.append(c - whole if 2 * c > whole else c)
    return out


def above(poly: list[int], x: int) -> int:
    """Number of roots greater than x of a polynomial whose roots are all real."""
    moved = list(poly)
    for k in range(len(moved) - 1):
        for j in range(len(moved) - 2, k - 1, -1):
            moved[j] += x * moved[j + 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign_at(poly: list[int], x: int) -> int:
    """Sign of the polynomial at x."""
    value = 0
    for c in reversed(poly):
        value = value * x + c
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], count: int, bits: int) -> list[tuple[int, int]]:
    """(root times 2 ** bits, rounded up; multiplicity), falling, until count roots are named.

    Roots closer than 2 ** -bits are one root of their joint multiplicity.
    """
    d = len(poly) - 1
    fine = [c << (bits * (d - k)) for k, c in enumerate(poly)]
    top = 1
    while above(fine, top):
        top *= 2
    out: list[tuple[int, int]] = []

    def search(lo: int, hi: int, over: int, upto: int) -> None:
        """Roots in (lo, hi], of which over lie above hi and upto above lo."""
        while over < min(upto, count):
            alone, end = upto - over == 1, sign_at(fine, hi)
            if alone and end:  # the sign tells the half
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (lo, mid) if sign_at(fine, mid) in (0, end) else (mid, hi)
            if alone or hi - lo == 1:
                out.append((hi, upto - over))
                return
            mid = (lo + hi) // 2
            n = above(fine, mid)
            search(mid, hi, over, n)
            hi, over = mid, n

    search(-1, top, 0, d)
    return out


def null_space(matrix: list[list[int]], root: int, bits: int, size: int) -> list[list[int]]:
    """size orthonormal vectors (times 2 ** scale) that the matrix multiplies by the root, by inverse iteration."""
    d = len(matrix)
    scale = bits + max(abs(x) for row in matrix for x in row).bit_length() + GUARD
    one = 1 << scale
    # (matrix - root), with the root a hair off, so that elimination finds no pivot of zero.
    a = np.array([[x << scale for x in row] for row in matrix], dtype=object)
    shift = (root << (scale - bits)) + (1 << (scale - bits - GUARD // 2))
    for k in range(d):
        a[k, k] -= shift
    order = list(range(d))
    for k in range(d - 1):
        best = k + int(np.argmax([abs(int(x)) for x in a[k:, k]]))
        if best != k:
            a[[k, best]] = a[[best, k]]
            order[k], order[best] = order[best], order[k]
        pivot = int(a[k, k]) or 1
        for i in range(k + 1, d):
            times = (int(a[i, k]) << scale) // pivot
            if times:
                a[i, k + 1 :] -= (a[k, k + 1 :] * times) >> scale
            a[i, k] = times
    found: list[list[int]] = []
    for start in range(size):
        v = [one if k % size == start else one // (k + 3) for k in range(d)]
        for _ in range(3):
            y = [v[k] for k in order]
            for k in range(1, d):
                y[k] -= sum(int(a[k, j]) * y[j] for j in range(k)) >> scale
            for k in range(d - 1, -1, -1):
                y[k] = ((y[k] - (sum(int(a[k, j]) * y[j] for j in range(k + 1, d)) >> scale)) << scale) // (int(a[k, k]) or 1)
            v = unit(y, found, scale)
        found.append(v)
    return found


def unit(v: list[int], others: list[list[int]], scale: int) -> list[int]:
    """v without its part along the others, of length one, at a scale."""
    big = max(abs(x) for x in v).bit_length() - scale
    v = [x >> big for x in v] if big > 0 else [x << -big for x in v]
    for _ in range(2):
        for u in others:
            along = sum(x * y for x, y in zip(u, v, strict=True)) >> scale
            v = [x - ((along * y) >> scale) for x, y in zip(v, u, strict=True)]
    length = isqrt(sum(x * x for x in v))
    v = [(x << scale) // max(length, 1) for x in v]
    sign = max(v, key=abs)
    return [-x for x in v] if sign < 0 else v


def spectrum(matrix: list[list[int]], count: int) -> tuple[list[float], np.ndarray]:
    """The largest positive eigenvalues, falling, each as often as it counts, and their unit eigenvectors as rows."""
    d = len(matrix)
    trace = sum(matrix[k][k] for k in range(d))
    if not d or trace <= 0:
        return [], np.empty((0, d))
    values: list[float] = []
    vectors: list[list[float]] = []
    bits = max(0, ROOT_BITS - trace.bit_length()) + 32
    for root, times in largest_roots(characteristic(matrix), min(count, d), bits):
        if root <= 1:  # zero, or below anything the matrix can tell from it
            break
        scale = bits + max(abs(x) for row in matrix for x in row).bit_length() + GUARD
        for v in null_space(matrix, root, bits, times)[: count - len(values)]:
            values.append(root / (1 << bits))
            vectors.append([x / (1 << scale) for x in v])
    return values, np.array(vectors).reshape(len(vectors), d)
