"""Compensated sums and whitening against exact rational arithmetic."""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import double_double as dd
from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, v string, n long, `a b` string"


def exact(pair, *at):
    return Fraction(float(pair[0][at])) + Fraction(float(pair[1][at]))


def numbers(seed, n, width, scale=1.0, shift=0.0):
    return np.random.default_rng(seed).normal(size=(n, width)) * scale + shift


@pytest.mark.parametrize("seed", range(4))
def test_transformations_lose_nothing(seed):
    a, b = numbers(seed, 50, 1, 10.0 ** (seed * 4)).ravel(), numbers(seed + 9, 50, 1).ravel()
    for (s, e), f in ((dd.two_sum(a, b), lambda x, y: x + y), (dd.two_product(a, b), lambda x, y: x * y)):
        assert all(Fraction(s[i]) + Fraction(e[i]) == f(Fraction(a[i]), Fraction(b[i])) for i in range(50))
    p = dd.two_sum(a, b * 1e-20)
    q = dd.divide(p, 7)
    s = dd.add(p, q)
    for i in range(50):
        assert abs(exact(q, i) - exact(p, i) / 7) <= abs(exact(q, i)) * Fraction(2) ** -100
        assert abs(exact(s, i) - exact(p, i) - exact(q, i)) <= abs(exact(p, i)) * Fraction(2) ** -100


@pytest.mark.parametrize(("n", "scale", "shift"), [(1, 1.0, 0.0), (2, 1e-9, 3.0), (700, 1.0, 1e6), (1100, 1e-3, 0.0)])
def test_outer_and_sums(n, scale, shift):
    y = numbers(n, n, 3, scale, shift)
    y[:, 1] *= 1e-6
    rows = [[Fraction(x) for x in r] for r in y.tolist()]
    sums, products = dd.column_sums(y), dd.outer((y, np.zeros_like(y)))
    for i in range(3):
        assert abs(exact(sums, i) - sum(r[i] for r in rows)) <= n * Fraction(max(abs(y[:, i]))) * Fraction(2) ** -100
        for j in range(3):
            most = n * Fraction(float(np.abs(y).max())) ** 2  # slices have a common unit for all columns
            assert abs(exact(products, i, j) - sum(r[i] * r[j] for r in rows)) <= most * Fraction(2) ** -80
    assert np.array_equal(products[0], products[0].T)
    assert exact(dd.column_sums(y[:0]), 0) == 0 and not dd.outer((y[:0], y[:0]))[0].any()


def test_products_that_doubles_lose(spark):
    """A spread of 1e-7 about 1e6: the plain sum of squares has no right digit, the compensated covariance nearly all."""
    y = 1e6 + numbers(5, 3000, 4) * 1e-7
    df = spark.createDataFrame([(r,) for r in y.tolist()], "v array<double>").repartition(7)
    n, sums, mean, cov = whitening.covariance(df, 4)
    rows = [[Fraction(x) for x in r] for r in y.tolist()]
    means = [sum(r[i] for r in rows) / 3000 for i in range(4)]
    for i in range(4):
        want = sum((r[i] - means[i]) ** 2 for r in rows) / 3000
        assert n == 3000 and abs(Fraction(float(cov[0][i, i])) - want) <= want * Fraction(2) ** -52
        plain = float(np.mean(y[:, i] ** 2) - np.mean(y[:, i]) ** 2)
        assert abs(plain - float(want)) > 0.9 * float(want)


def brute(rows, components=16):
    """(vec_id, component) -> (n, deviation, |whitened|, explained), with a covariance of exact rationals."""
    x = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    v = np.array([[float(Fraction(sum((n * a[i] - s[i]) * (n * a[j] - s[j]) for a in fit), n**3)) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(v)
    out = defaultdict(list)
    for i, a in x:
        y = np.array([float(Fraction(n * b - t, n)) for b, t in zip(a, s)])
        for k in range(min(components, d)):
            if e[-1 - k] > 1e-9 * e[-1]:
                out[i, k + 1].append((n, sum((n * b - t) ** 2 for b, t in zip(a, s)), abs(float(y @ q[:, -1 - k]) / e[-1 - k] ** 0.5), e[-1 - k] / np.trace(v)))
    return out


def made(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], SCHEMA).repartition(5)


def same(df, want):
    got = defaultdict(list)
    for r in df.collect():
        assert r["identity_error"] <= 1e-9
        got[r["vec_id"], r["component"]].append((r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
    assert set(got) == set(want)
    for k, rows in want.items():
        for a, b in zip(sorted(got[k]), sorted(rows), strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9, abs=1e-9)


def vectors(seed, n, width):
    base = numbers(seed, n, width) * np.linspace(3, 0.1, width)
    return [(i, np.float32(v).tolist()) for i, v in enumerate(base)]


@pytest.mark.parametrize(("n", "width"), [(150, 20), (60, 5), (12, 16)])
def test_same_as_exact(spark, n, width):
    rows = vectors(n, n, width)
    rows += [(500 + i, rows[3][1]) for i in range(70)] + [(None, rows[3][1]), (2, rows[4][1]), (2, rows[2][1])]  # copies count once in the fit
    same(whitening.whiten(whitening.scaled(made(spark, rows))), brute(rows))


def test_awkward_rows(spark):
    good = vectors(1, 40, 6)
    bad = [(90, None), (91, []), (92, [None] * 6), (93, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (94, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (95, [1.0, 2.0]), (96, [0.0] * 7)]
    df = made(spark, good + bad)
    same(whitening.whiten(whitening.scaled(df)), brute(good))
    assert whitening.whiten(whitening.scaled(df.where("vec_id < 0"))).count() == 0
    assert whitening.whiten(whitening.scaled(df.where("vec_id = 3"))).count() == 0  # one vector has no variance
    assert whitening.usual_length(whitening.scaled(df.where("vec_id >= 95"))) == 7


def test_huge_entries(spark):
    """Deviations beyond 64 bits are null, entries beyond the limit stay at it."""
    rows = [(0, [3.0e38, 0.0]), (1, [-3.0e38, 1.0]), (2, [1.0, 2.0]), (3, [5.0, 1.0])]
    got = whitening.whiten(whitening.scaled(made(spark, rows))).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2, 3} and all(math.isfinite(r["whitened"]) for r in got)
    assert {r["deviation"] for r in got if r["vec_id"] < 2} == {None}


def test_equal_entries_and_ties(spark):
    """Two directions of equal variance: their space is right whatever the basis."""
    rows = [(i, v) for i, v in enumerate([[1.0, 0.0, 5.0], [-1.0, 0.0, 5.0], [0.0, 1.0, 5.0], [0.0, -1.0, 5.0]])]
    got = whitening.whiten(whitening.scaled(made(spark, rows))).collect()
    assert {r["component"] for r in got} == {1, 2} and all(abs(r["explained"] - 0.5) < 1e-12 for r in got)
    norms = defaultdict(float)
    for r in got:
        norms[r["vec_id"]] += r["whitened"] ** 2
    assert all(abs(x - 2) < 1e-9 for x in norms.values())
