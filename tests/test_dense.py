"""Blocked search and one-pass hybrid retrieval against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from tessera.operators import dense
from tessera.operators import lexical as lx

SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("cosine", [False, True])
def test_nearest_in_blocks_is_brute_force(spark, cosine, monkeypatch):
    monkeypatch.setattr(dense, "VECTORS", 7)
    monkeypatch.setattr(dense, "QUERIES", 3)
    monkeypatch.setattr(dense, "SLAB", 2)
    r = random.Random(5)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)]) for i in range(60)]
    rows += [(60, [0.0, 0.0, 0.0]), (61, rows[0][1]), (62, rows[0][1])]
    df = spark.createDataFrame(rows + [(63, None), (64, [1.0, None, 0.0])], SCHEMA)
    got = dense.nearest(df, df.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), 4, cosine).collect()
    expected = set()
    for q, a in rows:
        scores = []
        for v, b in rows:
            norm = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
            if q % 5 or v == q or (cosine and not norm):
                continue
            s = sum(x * y for x, y in zip(a, b)) / norm if cosine else sum((x - y) ** 2 for x, y in zip(a, b))
            scores.append((-round(s, 6) if cosine else round(s, 6), v))
        expected |= {(q, v, k + 1) for k, (_, v) in enumerate(sorted(scores)[:4])}
    assert {(x["query_id"], x["vec_id"], x["rank"]) for x in got} == expected


def test_nearest_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(0, [1.0, 2.0])], SCHEMA)
    assert dense.nearest(none, none.withColumnRenamed("vec_id", "query_id"), 3, True).collect() == []
    assert dense.nearest(one, one.withColumnRenamed("vec_id", "query_id"), 3, False).collect() == []


CORPUS = [(i, t) for i, t in enumerate(["a b c", "b b d", "", None, "d e f a", "a a a", "Ünïcode dé b", "b c"])]
ASKS = [(1, "a b b"), (2, "d"), (3, ""), (4, None), (5, "zz")]


def _frames(spark):
    return spark.createDataFrame(CORPUS, "chunk_id long, text string"), spark.createDataFrame(ASKS, "query_id long, text string")


def test_hybrid_is_two_lists_fused(spark):
    corpus, asks = _frames(spark)
    pairs = lx.channels(corpus, asks)
    lists = [lx.top(pairs.select("query_id", "chunk_id", pairs[c].alias("score")), 2) for c in ("score", "cosine")]
    order = ["query_id", "rank"]
    expected = lx.fuse(*lists).orderBy(order)
    assert lx.hybrid(corpus, asks, depth=2).select(expected.columns).orderBy(order).collect() == expected.collect()


def test_large_query_sets_are_shuffled_to_the_same_scores(spark, monkeypatch):
    corpus, asks = _frames(spark)
    sent = sorted(map(tuple, lx.channels(corpus, asks).collect()))
    monkeypatch.setattr(lx, "BROADCAST", -1)
    shuffled = sorted(map(tuple, lx.channels(corpus, asks).collect()))
    assert [x[:2] for x in sent] == [x[:2] for x in shuffled] and all(math.isclose(a, b) for x, y in zip(sent, shuffled) for a, b in zip(x[2:], y[2:]))


def test_gram_top_by_hand(spark, monkeypatch):
    monkeypatch.setattr(dense, "SPARSE_VECTORS", 2)
    monkeypatch.setattr(dense, "SPARSE_QUERIES", 1)
    monkeypatch.setattr(lx, "GRAMS", 5)
    corpus, asks = _frames(spark)
    grams = lambda t: Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1))
    counts = {i: grams(t.lower()) for i, t in CORPUS if t is not None}
    df, every = Counter(g for c in counts.values() for g in c), Counter()
    for c in counts.values():
        every.update(c)
    known = sorted(every, key=lambda g: (-every[g], g.encode()))[:12]
    idf = {g: math.log((1 + len(CORPUS)) / (1 + df[g])) + 1 for g in known}

    def vector(c):
        w = {g: c[g] * idf[g] for g in known if c[g]}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    expected = set()
    for q, t in ASKS:
        a = vector(grams((t or "").lower()))
        scores = [(-round(s, 6), i) for i, c in counts.items() if (s := sum(x * a.get(g, 0) for g, x in vector(c).items())) > 0]
        expected |= {(q, i, -s, k + 1) for k, (s, i) in enumerate(sorted(scores)[:3])}
    assert set(map(tuple, lx.gram_top(corpus, asks, 3, features=12).collect())) == expected


def test_passages_where_documents_lie(spark):
    """All passages of a document, overlapping and inner ones too."""
    from tessera.plans import retrieval

    passages = {"a b": [1], "b c": [2, 7], "a b c": [3], "zz": [4], "": [9], "é": [5]}
    docs = [(1, "x a b c y"), (2, "a b"), (3, ""), (4, "é zz é"), (5, "ab c")]
    got = retrieval.contained(spark.createDataFrame(docs, "chunk_id long, text string").repartition(2), passages).collect()
    assert sorted(map(tuple, got)) == sorted((q, d) for d, t in docs for p, ids in passages.items() if p in t for q in ids)
    assert {tuple(r) for r in retrieval.contained(spark.createDataFrame(docs, "chunk_id long, text string"), {}).collect()} == set()
