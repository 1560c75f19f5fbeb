"""The prefix trie and its merge against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import lcp_merge, prefix_trie


def brute(data):
    """Node rows for (conv_id, turn, role, text) rows, by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(turns.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def words(p):
        return len([w for w in __import__("re").split("[ \t-\r]+", p[-1][1]) if w]) if p else 0

    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if paths[c] == p)))
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in below),
            sum((len(members[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, node string, `a b` string, part int, path string, `words` string"


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(spark, data):
    return spark.createDataFrame([(*x, "n", "x", 3, "p", "w") for x in data], SCHEMA)


def talk(seed, convs=90):
    r = random.Random(seed)
    out = []
    for c in r.sample(range(-30, 400), convs):
        for t in range(r.choice([1, 1, 2, 3, 5, 9])):
            out.append((c, t, r.choice(["user", "assistant"]), r.choice(["hi", "hi", "how are you", "a b c", "", " \t", "Ü 日本"])))
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "parts"), [(0, None), (1, 1), (2, 2), (3, 7), (4, 40)])
def test_same_as_brute_force(spark, seed, parts):
    data = talk(seed)
    assert found(prefix_trie.trie(prefix_trie.rebuilt(made(spark, data)), parts)) == brute(data)


def test_one_conversation_of_a_third_of_all(spark):
    """Equal conversations are divided among ranges and their ends still come in one order."""
    data = [(c, t, "user", f"{t} same words") for c in range(0, 8000, 20) for t in range(3)] + talk(7, 60)
    data = list({(c, t): (c, t, r, x) for c, t, r, x in data}.values())
    df = prefix_trie.rebuilt(made(spark, data)).repartition(5)
    assert found(prefix_trie.trie(df, 16)) == brute(data)


def test_awkward_rows(spark):
    data = [
        (None, 0, "user", "no conversation"), (20, None, None, None), (20, None, "user", "b"), (20, 1, "user", "c"), (20, 1, "user", "c"), (20, 1, "user", "a"),
        (21, 5, "user", "x"), (27, 0, None, ""), (22, 0, "", None), (43, 0, "user", "w " * 60_000), (44, 0, "user", "w " * 60_000), (-3, 0, "ab", "c"), (-4, 0, "a", "bc"),
    ]
    df = made(spark, data)
    assert found(prefix_trie.trie(prefix_trie.rebuilt(df))) == brute(data)
    assert found(prefix_trie.trie(prefix_trie.rebuilt(df), 6)) == brute(data)
    assert prefix_trie.trie(prefix_trie.rebuilt(df.where("conv_id IS NULL"))).count() == 0


def test_long_conversations_and_long_splitters(spark):
    """Conversations that part only behind what a splitter holds."""
    data = [(c, t, "user", "same" if t < 80 else f"{c % 3} {t}") for c in range(20, 440, 20) for t in range(100)]
    assert found(prefix_trie.trie(prefix_trie.rebuilt(made(spark, data)), 5)) == brute(data)


def rest(r, n):
    return b"".join(bytes([r.choice(b"ab")]) * 16 for _ in range(n))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_merge(k, monkeypatch):
    r = random.Random(k)
    items = [(s := rest(r, r.randint(0, 9)), i, bytes(4 * (len(s) // 16))) for i in range(60 * k)]
    runs = [sorted(items[i::k]) for i in range(k)]
    packed = [lcp_merge.pack(x) for x in runs]
    got = list(lcp_merge.merge(packed))
    assert [(x.steps, x.id) for x in got] == sorted(x[:2] for x in items)
    before = b""
    for x in got:
        assert x.lcp == lcp_merge.common(before, x.steps) >= x.first and len(x.weights) == len(x.steps) // 16 - x.first
        before = x.steps


def test_shared_steps_are_not_compared_again(monkeypatch):
    """1,000 equal steps in front of every sequence cost nothing after the first comparisons."""
    runs = [lcp_merge.pack([(b"s" * 16 * 1000 + bytes([i, j]) * 8, i * 50 + j, bytes(4004)) for j in range(50)]) for i in range(8)]
    starts, plain = [], lcp_merge.common
    monkeypatch.setattr(lcp_merge, "common", lambda a, b, start=0: starts.append(start) or plain(a, b, start))
    assert len(list(lcp_merge.merge(runs))) == 400
    assert sum(s < 1000 for s in starts) <= 8


def test_common():
    r = random.Random(1)
    for _ in range(300):
        a, b = rest(r, r.randint(0, 12)), rest(r, r.randint(0, 12))
        n = next((i for i in range(min(len(a), len(b)) // 16) if a[16 * i : 16 * i + 16] != b[16 * i : 16 * i + 16]), min(len(a), len(b)) // 16)
        assert lcp_merge.common(a, b) == n and lcp_merge.common(a, b, n // 2) == n
