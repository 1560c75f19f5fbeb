"""The inverted-file index against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tessera.operators import ann, dense

SCHEMA = "vec_id long, embedding array<float>, label int, score double, `list` int"


def clusters(seed, n, width=6, groups=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, width)) * 4
    return [(i, np.float32(centres[i % groups] + r.normal(size=width)).tolist(), i % groups if i % 3 else 0, 0.5, 9) for i in range(n)]


def brute(rows, asked, k, scoped=False):
    out = set()
    for q in asked:
        near = sorted((round(sum((x - y) ** 2 for x, y in zip(q[1], v[1])), 6), v[0]) for v in rows if v[0] != q[0] and (not scoped or v[2] == q[2]))
        out |= {(q[0], v, i + 1) for i, (_, v) in enumerate(near[:k])}
    return out


def found(df):
    return {(r["query_id"], r["vec_id"], r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return clusters(3, 300)


@pytest.fixture(scope="module")
def index(spark, rows):
    return ann.build(spark.createDataFrame(rows, SCHEMA).repartition(4), lists=12, scope="label")


def asked(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumnRenamed("vec_id", "query_id")


def test_every_vector_is_indexed_once(index, rows):
    held = [(r["vec_id"], r["list"]) for r in index.table.collect()]
    assert sorted(i for i, _ in held) == [r[0] for r in rows]
    for i, list_ in held:
        d = ((index.centroids - np.array(rows[i][1])) ** 2).sum(1)
        assert d[list_] <= d.min() + 1e-9 and math.sqrt(d[list_]) <= index.radius[list_] + 1e-9


@pytest.mark.parametrize("probes", [1, 3, 12])
def test_exact_search_is_brute_force(spark, index, rows, probes):
    q = rows[::10]
    assert found(ann.search(index, asked(spark, q), 7, probes, exact=True)) == brute(rows, q, 7)


def test_few_probes_find_most(spark, index, rows):
    q = asked(spark, rows[::5])
    exact = dense.nearest(spark.createDataFrame(rows, SCHEMA), q, 5, cosine=False)
    share = [ann.recall(ann.search(index, q, 5, p), exact).first()["recall"] for p in (1, index.probes(), 12)]
    assert share[0] < 1 and share[1] >= 0.95 and share[2] == 1.0


def test_exact_search_reads_few_lists(spark, index, rows):
    """Of clustered vectors the second step asks few of the lists that are left."""
    q = asked(spark, rows[::5])
    first = ann.search(index, q, 5, 3)
    kth = first.groupBy("query_id").agg({"score": "max"}).withColumnRenamed("max(score)", "within")
    frame = ann.usable(q, "query_id").join(kth, "query_id")
    assert ann._probed(frame, index, 3, True).count() < 0.5 * 9 * 60


@pytest.mark.parametrize("narrow", [0, 100, 1000])
def test_scoped_is_brute_force(spark, index, rows, narrow, monkeypatch):
    monkeypatch.setattr(ann, "NARROW", narrow)
    q = rows[::7]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(ann.scoped(index, df, asked(spark, q), 6, "label")) == brute(rows, q, 6, scoped=True)


def test_a_hot_list_is_divided(spark, monkeypatch):
    """Equal vectors, a third of all, share a list but not a task; ties go to the least ids."""
    monkeypatch.setattr(ann, "VECTORS", 20)
    monkeypatch.setattr(ann, "QUERIES", 4)
    rows = clusters(8, 200) + [(1000 + i, [0.0] * 6, 1, 0.5, 9) for i in range(100)]
    index = ann.build(spark.createDataFrame(rows, SCHEMA).repartition(4), lists=8)
    assert index.parts.max() >= 5
    largest = index.table.groupBy("list", "part").count().agg({"count": "max"}).first()[0]
    assert largest < 60
    q = rows[::20]
    assert found(ann.search(index, asked(spark, q), 9, 2, exact=True)) == brute(rows, q, 9)


def test_awkward_rows(spark):
    r = random.Random(2)
    good = [(i, [r.random(), r.random()], 1, None, None) for i in range(30)] + [(40, [0.5, 0.5], None, None, None), (41, [0.5, 0.5], None, None, None)]
    bad = [(50, None, 1, None, None), (51, [1.0, None], 1, None, None), (52, [float("nan"), 0.0], 1, None, None), (53, [], 1, None, None)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    index = ann.build(df, scope="label")
    q = asked(spark, good[::4] + bad)
    assert found(ann.search(ann.build(df), q, 3, 1, exact=True)) == brute(good, good[::4], 3)
    assert found(ann.search(index, q, 40, exact=True, scope="label")) == brute([g for g in good if g[2]], [g for g in good[::4] if g[2]], 40, scoped=True)
    none = df.where("vec_id < 0")
    assert ann.search(ann.build(none), q, 3).count() == 0
    assert ann.search(index, q.where("query_id < 0"), 3, exact=True).count() == 0
