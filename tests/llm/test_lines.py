"""Line deduplication and its perfect hash against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import line_dedup, perfect_hash

from .conftest import CLASHING_SCHEMA, clashing, prose

BLANK = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data):
    """(doc_id, n_lines, n_dropped, kept text) for each (doc_id, text)."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = defaultdict(list)
    least = -(2**63)
    for i, t in data:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append(least if i is None else i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, t in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == (least if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df):
    got = df.collect()
    for r in got:
        assert r["kept_sha256"] == hashlib.sha256(r["kept_text"].encode()).hexdigest()
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got), key=repr)


def shared_lines(seed, n):
    r = random.Random(seed)
    common = [prose(100 + i, 8) for i in range(12)] + ["x" * 19, "x" * 20, "é" * 19, "é" * 20, "日本" * 10, " " * 40]
    def line():
        x = r.choice(common) if r.random() < 0.5 else prose(r.random(), r.randint(0, 9))
        return r.choice(["", " ", "\t\r", "\v\f"]) + (x.upper() if x.isascii() and r.random() < 0.3 else x) + r.choice(["", "  ", "\r"])
    return [(i, "\n".join(line() for _ in range(r.randint(0, 12)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    data = shared_lines(seed, 120)
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute(data)
    assert sum(x[2] for x in want) > 50
    assert found(line_dedup.dedup(df, texts=True)) == want


def test_many_shards_and_cells(spark):
    data = shared_lines(9, 150)
    df = spark.createDataFrame(data, "doc_id long, text string")
    index = line_dedup.index(df, 37)
    assert 30 < index.count() <= 37
    assert found(line_dedup.probe(df, index, 37, 23, texts=True)) == brute(data)


def test_awkward_rows(edge, nothing):
    data = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert found(line_dedup.dedup(edge, texts=True)) == brute(data)
    assert line_dedup.dedup(nothing).count() == 0 and line_dedup.index(nothing, 4).count() == 0


def test_null_ids_repeated_ids_and_ties(spark):
    line = "a line that many documents hold"
    data = [(None, line), (None, line), (None, line), (3, "b" + line), (3, "b" + line + "\nb" + line), (2, "b" + line + "\nx"), (5, "c" + line), (5, "c" + line)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert found(line_dedup.dedup(df, texts=True)) == brute(data)


def test_columns_that_clash(spark):
    data = clashing(30)
    df = spark.createDataFrame(data, CLASHING_SCHEMA)
    assert found(line_dedup.dedup(df, texts=True)) == brute([x[:2] for x in data])


def test_foreign_documents_ask_an_index(spark):
    line = prose(4, 12)
    base = spark.createDataFrame([(i, line) for i in range(5)], "doc_id long, text string")
    new = spark.createDataFrame([(9, line + "\nsomething that nobody else has written"), (1, line)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.probe(new, line_dedup.index(base, 3), 3, 2, texts=True).collect()}
    assert got == {9: line + "\nsomething that nobody else has written", 1: ""}


def test_a_gathering_task_sends_in_parts(spark):
    data = shared_lines(5, 60)
    df = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    index = line_dedup.index(df, 3, gather=7)
    assert found(line_dedup.probe(df, index, 3, 5, texts=True)) == brute(data)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    sizes, bits = perfect_hash.build(keys)
    assert sorted(perfect_hash.number(keys, sizes, bits).tolist()) == list(range(len(keys)))
    assert len(bits) * 8 <= 5 * len(keys) + 64
    others = np.arange(100, dtype=np.uint64)
    assert (perfect_hash.number(others, sizes, bits) < max(1, len(keys))).all()


def test_counts_take_the_bytes_that_they_need():
    assert [len(line_dedup._compact(np.array([1, n]))) for n in (2, 255, 256, 70_000, 1 << 40)] == [2, 2, 4, 8, 16]
