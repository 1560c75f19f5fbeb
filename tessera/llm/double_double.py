"""Sums and products in double-double: a number is the unevaluated sum of a high and a low double.

``two_sum`` and ``two_product`` are error-free transformations (Knuth; Dekker): result and rounding error
are both exact. ``outer`` does it for whole blocks of rows: entries are cut into slices so
short that the products of two slices, summed over a block, fit in a double without
rounding (Ozaki et al., 2012); so the matrix products are exact, and only their sum is
rounded, in double-double.
"""

from __future__ import annotations

import numpy as np

#: Rows of a block and bits of a slice: BLOCK products of two slices need 2 * BITS + log2(BLOCK) = 53 bits.
BLOCK, BITS = 512, 22

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    def halves(x: np.ndarray) -> Pair:
        c = 134217729.0 * x
        high = c - (c - x)
        return high, x - high

    p = a * b
    (ah, al), (bh, bl) = halves(np.asarray(a, dtype=float)), halves(np.asarray(b, dtype=float))
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: Pair, b: Pair) -> Pair:
    """The sum of two double-doubles, to about 2**-104."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def divide(a: Pair, n: int) -> Pair:
    """A double-double over a whole number below 2**53."""
    q = a[0] / n
    p, e = two_product(q, np.float64(n))
    r = ((a[0] - p) - e) + a[1]
    return two_sum(q, r / n)


def zeros(shape: tuple[int, ...]) -> Pair:
    return np.zeros(shape), np.zeros(shape)


def _slices(y: Pair, n: int = 4) -> list[np.ndarray]:
    """``y`` as a sum of ``n`` arrays, whose entries are multiples of a common power of two of at most BITS bits each."""
    high, low = y
    most = float(np.max(np.abs(high), initial=0.0))
    out = []
    if not most:
        return out
    top = int(np.frexp(most)[1])  # all |entries| < 2**top, and |what is left| <= 2**(top - BITS * k)
    for k in range(n):
        sigma = np.ldexp(1.5, top - BITS * (k + 1) + 52)
        part = (high + sigma) - sigma
        high, low = two_sum(high - part, low)
        out.append(part)
    return out


def outer(y: Pair) -> Pair:
    """The sum over all rows of the outer product of a row with itself."""
    total = zeros((y[0].shape[1],) * 2)
    for s in range(0, len(y[0]), BLOCK):
        parts = _slices((y[0][s : s + BLOCK], y[1][s : s + BLOCK]))
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[i : len(parts) - i], i):
                g = a.T @ b
                for exact in (g,) if i == j else (g, g.T):
                    total = add(total, (exact, np.zeros_like(exact)))
    return total


def column_sums(y: np.ndarray) -> Pair:
    """The sum of all rows: added in pairs, level by level, with their rounding errors."""
    pair = (y, np.zeros_like(y)) if len(y) else zeros((1, *y.shape[1:]))
    while len(pair[0]) > 1:
        n = len(pair[0]) // 2
        left, right, rest = (tuple(x[s] for x in pair) for s in (slice(n), slice(n, 2 * n), slice(2 * n, None)))
        pair = tuple(np.concatenate(x) for x in zip(add(left, right), rest))
    return pair[0][0], pair[1][0]
