"""Order statistics by group against sorted lists."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators.ranks import at_ranks

RANKS = {"first": lambda n: F.lit(1), "mid": lambda n: F.floor(n / 2) + 1, "p95": lambda n: F.ceil(0.95 * n), "beyond": lambda n: n + 1}


def test_ranks_are_those_of_sorted_values(spark):
    r = random.Random(3)
    groups = {
        "near": [1e6 + r.random() / 100 for _ in range(200)],  # all in one bucket
        "tied": [2.5] * 70 + [-2.5] * 30,
        "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-9, 12) for _ in range(300)],
        "one": [0.0],
        "inf": [float("inf"), float("-inf"), 1.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("near", None), ("void", None)]
    r.shuffle(rows)
    got = {x["g"]: x for x in at_ranks(spark.createDataFrame(rows, "g string, v double"), "g", "v", RANKS).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        o, n = sorted(vs), len(vs)
        assert tuple(got[g]) == (g, n, o[0], o[n // 2], o[-(-19 * n // 20) - 1], None), g


def test_ranks_of_an_empty_table(spark):
    assert at_ranks(spark.createDataFrame([], "g string, v double"), "g", "v", RANKS).collect() == []


def test_null_group_is_kept(spark):
    out = at_ranks(spark.createDataFrame([(None, 1.0), (None, 3.0)], "g string, v double"), "g", "v", {"last": lambda n: n})
    assert [tuple(x) for x in out.collect()] == [(None, 2, 3.0)]
