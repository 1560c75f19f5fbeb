"""Operators on their own, with awkward inputs, against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import lexical as lx
from tessera.operators.segments import cuts, greedy_batches, split_texts, weighted_limit
from tessera.sources.tables import spread
from tessera.sources.versions import VersionStore, incremental
from tessera.streaming import limits

TOKEN = re.compile("0x[0-9a-f]+|[a-z]+[a-z0-9]*(?:[._-][a-z0-9]+)*|[0-9]+(?:[.][0-9]+)*|[一-鿿]+")


def tokens(text):
    out = []
    for w in TOKEN.findall((text or "").lower()):
        out += [*w, *(w[i : i + 2] for i in range(len(w) - 1))] if "一" <= w[0] <= "鿿" else [w]
    return out


TEXTS = ["The AX-200 v2.10.3 and 0xFF", "", None, "重启设备 reset 重", "a a a b", "Zähler e07 E07. 12.5.1 kg"]


def test_tokens(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string")
    assert [r[1] or [] for r in df.select("chunk_id", lx.tokens(F.col("text"))).orderBy("chunk_id").collect()] == [tokens(t) for t in TEXTS]


def test_bm25(spark):
    r = random.Random(1)
    corpus = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 12)))) for i in range(30)] + [(30, None)]
    asks = [(1, "a b b z"), (2, ""), (3, "c")]
    docs = {i: Counter(tokens(t)) for i, t in corpus}
    mean = sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(w for c in docs.values() for w in c)
    expected = {}
    for q, text in asks:
        for i, c in docs.items():
            s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in tokens(text) if c[w])
            if s:
                expected[q, i] = s
    out = lx.bm25(spark.createDataFrame(corpus, "chunk_id long, text string"), spark.createDataFrame(asks, "query_id long, text string"))
    got = {(x["query_id"], x["chunk_id"]): x["score"] for x in out.collect()}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k]) for k in got)
    best = lx.top(out, 3).where("query_id = 1").orderBy("rank").collect()
    assert [x["chunk_id"] for x in best] == [i for _, i in sorted((-round(s, 6), i) for (q, i), s in expected.items() if q == 1)[:3]]


def test_fuse_keeps_both_sides(spark):
    a = spark.createDataFrame([(1, 10, 1, 5.0), (1, 11, 2, 4.0)], "query_id long, chunk_id long, rank long, score double")
    b = spark.createDataFrame([(1, 11, 1, 0.9), (1, 12, 2, 0.0)], a.schema)
    out = {r["chunk_id"]: r for r in lx.fuse(a, b).collect()}
    assert out[11]["rank"] == 1 and out[10]["vector_rank"] is None and out[12]["lexical_score"] is None
    assert math.isclose(out[11]["score"], round(1 / 62 + 1 / 61, 9))


def test_gram_vectors_have_length_one(spark):
    docs = spark.createDataFrame([(1, "Abc  abc"), (2, "x"), (3, None), (4, "abd")], "chunk_id long, text string")
    sums = {r[0]: r[1] for r in lx.gram_weights(docs).select("chunk_id", F.aggregate("weights", F.lit(0.0), lambda a, x: a + x * x)).collect()}
    assert sums.keys() == {1, 4} and all(math.isclose(v, 1) for v in sums.values())


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n;。"), max_size=300), st.integers(8, 40))
def test_cuts_cover_the_text(text, size):
    overlap = size // 4
    found = cuts(text, size, overlap)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for (a, b), (c, _) in zip(found, found[1:]):
        assert a < c <= b and b - a <= size and c == b - overlap
        assert b - a == size or text[b - 1] in "\n;。 "


def test_split_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 400), (2, None), (3, "  "), (4, "short")], "chunk_id long, text string")
    out = split_texts(docs).collect()
    assert {r["chunk_id"] for r in out} == {1, 4} and all(len(r["text"]) <= 800 for r in out)
    with pytest.raises(ValueError):
        split_texts(docs, 100, 60)


def test_greedy_batches(spark):
    r = random.Random(2)
    rows = [(k, i, r.randint(0, 90)) for k in range(6) for i in range(k * 5)]
    expected = {}
    for k in range(6):
        own = [(i, n) for kk, i, n in rows if kk == k]
        total = sum(n for _, n in own)
        target = max(1, math.ceil(total / max(1, math.ceil(total / 200)))) if own else 0
        used = batch = 0
        for i, n in own:
            if used > 0 and used + n > target:
                batch, used = batch + 1, 0
            used += n
            expected[k, i] = batch
    out = greedy_batches(spark.createDataFrame(rows, "k long, i long, n long"), "k", "i", "n", 200)
    assert {(x["k"], x["i"]): x["batch"] for x in out.collect()} == expected


def calls():
    r = random.Random(3)
    return [(i, r.randint(1, 4), f"2024-01-0{r.randint(1, 3)} 0{r.randint(0, 9)}:00:00", r.randint(1, 4)) for i in range(120)]


def limited():
    used, out = defaultdict(int), {}
    for i, user, ts, n in calls():
        fits = used[user, ts[:10]] + n <= 7
        used[user, ts[:10]] += n * fits
        out[i] = fits
    return used, out


def test_weighted_limit(spark):
    rows = spark.createDataFrame([(i, u, t[:10], n) for i, u, t, n in calls()], "event_id long, user_id long, day string, amount long")
    out = weighted_limit(rows, ["user_id", "day"], ["event_id"], "amount", 7).collect()
    assert {(r["user_id"], r["day"]): r["used"] for r in out} == limited()[0]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, u, t, n, "x" if n > 2 else "y", float(n)) for i, u, t, n in calls()], "event_id long, user_id long, t string, amount long, event_type string, value double")
    rows = rows.withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = limits.run_once(limits.window_limit(stream(), 7, late="30 days"), "t_limit").collect()
    assert {r["call"]: r["allowed"] for r in out} == limited()[1]
    counts = limits.run_once(limits.tumbling_counts(stream(), late="0 seconds"), "t_counts", folder=f"{tmp_path}/out").collect()
    held = rows.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()
    final = {(r["start"], r["event_type"]): r["n"] for r in counts}
    assert final and all(final[k] == n for k, n in (((r["d"], r["event_type"]), r["n"]) for r in held) if k in final)
    last = limits.run_once(limits.latest_state(stream()), "t_last", "complete").collect()
    best = {}
    for i, u, t, _ in calls():
        best[u] = max(best.get(u, ("", -1)), (t, i))
    assert {r["user_id"]: r["event_id"] for r in last} == {u: i for u, (_, i) in best.items()}
    assert limits.run_once(limits.first_writes(stream(), ["user_id", "event_type"]), "t_first").count() == len({(u, n > 2) for _, u, _, n in calls()})


def test_versions(spark, tmp_path):
    store = VersionStore(spark, f"file://{tmp_path}/store")
    assert store.active() is None and store.versions().count() == 0
    one = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    store.publish(one, "v1")
    store.publish(one.where("id = 1"), "v2")
    assert store.active() == "v2" and store.read().count() == 1 and store.read("v1").count() == 2
    store.activate("v1")
    assert store.active() == "v1" and [r["active"] for r in store.versions().orderBy("version").collect()] == [True, False]
    assert store.verify("v1") and not store.verify("v9")
    with pytest.raises(ValueError):
        store.activate("v9")
    with pytest.raises(Exception):
        store.publish(one, "v1")
    spark.createDataFrame([(3, "x")], one.schema).write.mode("append").parquet(f"{tmp_path}/store/data/version=v1")
    assert not store.verify("v1")


def test_incremental(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, text string")
    after = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "name string, text string")
    assert {r["name"]: r["action"] for r in incremental(before, after).collect()} == {"a": "reuse", "b": "parse", "c": "remove", "d": "parse"}


def test_spread_only_small_tables_in_few_files(spark, tmp_path):
    df = spark.range(100)
    df.repartition(1).write.parquet(f"{tmp_path}/one")
    df.repartition(20).write.parquet(f"{tmp_path}/many")
    plan = lambda n: spread(spark.read.parquet(f"{tmp_path}/{n}"))._jdf.queryExecution().toString()
    assert "RoundRobin" in plan("one") and "RoundRobin" not in plan("many")
