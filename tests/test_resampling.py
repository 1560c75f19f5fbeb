"""Split halves against trials that go over all records."""

from __future__ import annotations

import hashlib
import random

import pytest

from tessera.operators import resampling as rs

SCHEMA = "key long, ratio double, gated boolean, expected boolean, decided boolean, partial boolean"


def bit(key, t):
    return int(hashlib.md5(f"{key}:{t // 128}".encode()).hexdigest(), 16) >> (127 - t % 128) & 1


def judged(rows, tau=None):
    correct = risk = 0
    for _, ratio, gated, expected, decided, partial in rows:
        if tau is not None and gated and ratio is not None and ratio > tau:
            decided = False
        if decided:
            kind = ("partial" if partial else "correct") if expected else "fa"
        else:
            kind = "fr" if expected else "correct"
        correct += kind == "correct"
        risk += {"fa": 10, "fr": 1, "partial": 1, "correct": 0}[kind]
    return correct, risk


def brute(rows, trials):
    out = []
    for t in range(trials):
        cal, test = [r for r in rows if bit(r[0], t)], [r for r in rows if not bit(r[0], t)]
        tau = max((i / 100 for i in rs.GRID), key=lambda x: (lambda m: (m[0], -m[1]))(judged(cal, x)))
        out.append((t, tau, len(cal), len(test), *judged(test, tau), *judged(test)))
    return out


@pytest.mark.parametrize("n", [1, 3, 150])
def test_same_as_all_trials(spark, n):
    r = random.Random(n)
    rows = [(i, r.choice([None, r.uniform(0.5, 3.2), r.choice(rs.GRID) / 100]), r.random() < 0.7, r.random() < 0.5, r.random() < 0.7, r.random() < 0.2) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows, 140)
    got = rs.split_half(df, 140)
    assert sorted(tuple(x) for x in got.collect()) == want
    tested = [w for w in want if w[3]]
    s = rs.summary(got).first()
    assert s["risk_mean"] == pytest.approx(sum(w[5] for w in want) / len(want))
    if n == 150:
        assert s["accuracy_mean"] == pytest.approx(sum(w[4] / w[3] for w in tested) / len(tested)) and len({w[1] for w in want}) > 1


def test_null_flags_and_no_records(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None), (2, 9.0, True, None, True, None)], SCHEMA)
    assert sorted(tuple(x) for x in rs.split_half(df, 9).collect()) == brute([(1, None, False, False, False, False), (2, 9.0, True, False, True, False)], 9)
    assert rs.split_half(df.where("key < 0")).count() == 0


def test_counts_do_not_grow_with_records(spark):
    df = spark.range(20_000).selectExpr("id AS key", "0.8 + id % 200 / 100.0 AS ratio", "true AS gated", "id % 3 = 0 AS expected", "id % 2 = 0 AS decided", "id % 7 = 0 AS partial")
    assert rs.class_counts(df, 40).count() <= 8 * 45 * 40
