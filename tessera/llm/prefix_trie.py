"""The prefix trie of conversations by an LCP-aware external mergesort.

A turn is its 128-bit hash, a conversation the string of its turns' hashes. Tasks sort
what they have read into runs that carry LCPs, cut them at splitters (drawn from a sample
of the conversations, by path and id, so that even equal conversations are divided), and
send each piece to its range. A range merges its pieces with a loser tree
(``lcp_merge``); the merged stream moves a stack of open nodes, and a node that the next
conversation does not share is finished. Nodes on a range's first and last path may go on
in its neighbours: these edge nodes, no more than two paths for each range, are added up
afterwards. Texts stay where they are read; what moves of a turn is 16 bytes of hash and
its number of words.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.lcp_merge import STEP, Run, merge, pack
from tessera.llm.shared import bounded, settle, table, words

#: Conversations that begin alike: each takes its first turns from the one whose number ends the family.
FAMILY, HEADS = 20, 4
#: Bytes of paths for each range: from the first number, while a range for each partition of the shuffle does, up to the second.
RANGE = (256 << 10, 16 << 20)
#: Bytes of paths in a run.
RUN = 8 << 20
#: Conversations in the sample for each range, and bytes of a path that a splitter holds at most.
SAMPLE, SPLITTER = 32, 64 * STEP

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COUNTS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
_DONE, _WAITING, _EDGE = range(3)
_MERGED = f"kind int, part int, node binary, parent binary, words long, ends binary, {NODE}"
_RUN = "part int, ids binary, lcps binary, sizes binary, steps binary, weights binary"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (turn hashes one after another) and words (of each turn) of every rebuilt conversation.

    Turns come in order of turn, null first, ties in order of the turn's hash. Rows
    without a conv_id belong to no conversation. A family's head and its at most 20
    members meet by the head's number; a conversation's hashes, 16 bytes a turn, are
    held as one value.
    """
    bounded(conversations.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn"), F.unhex(F.md5(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))).alias("hash"), F.size(words(text)).alias("words")
        ).alias("step"),
    )
    own = turns.withColumn("head", F.expr(f"conv_id - conv_id % {FAMILY}")).repartition("head").groupBy("head", "conv_id").agg(F.sort_array(F.collect_list("step")).alias("own"))
    first = F.max(F.when(F.expr("conv_id = head"), F.slice("own", 1, HEADS - 1))).over(Window.partitionBy("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    steps = F.concat(F.slice(F.coalesce("first", F.slice("own", 1, 0)), F.lit(1), F.col("taken")), F.slice("own", F.col("taken") + 1, F.greatest(F.size("own") - F.col("taken"), F.lit(0))))
    return (
        own.select("conv_id", "own", first.alias("first"), taken.alias("taken"))
        .select("conv_id", steps.alias("steps"))
        .select("conv_id", F.unhex(F.array_join(F.transform("steps", lambda s: F.hex(s["hash"])), "")).alias("path"), F.transform("steps", lambda s: s["words"]).alias("words"))
    )


def _splitters(paths: DataFrame, parts: int) -> list[tuple[bytes, int]]:
    """Up to ``parts`` - 1 pairs (path, id) that divide the paths evenly; a path is cut at SPLITTER bytes, which are as good a place."""
    if parts < 2:
        return []
    least = np.iinfo(np.int64).min
    drawn = paths.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLE * parts)
    cut = drawn.select(F.substring("path", 1, SPLITTER).alias("path"), F.when(F.octet_length("path") > SPLITTER, F.lit(least)).otherwise(F.col("conv_id")).alias("id"))
    sample = sorted((bytes(r["path"]), r["id"]) for r in cut.collect())
    return sorted(set(sample[SAMPLE::SAMPLE]))


def _runs(splitters: list[tuple[bytes, int]]):
    """The function that sorts a task's paths into runs and cuts them at the splitters."""

    def cut(items: list[tuple[bytes, int, bytes]]) -> Iterator[pa.RecordBatch]:
        items.sort()
        edges = [0, *(bisect_left(items, s, key=lambda x: x[:2]) for s in splitters), len(items)]
        for part, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
            if e > s:
                arrays = [pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in pack(items[s:e]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", *Run._fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, size = [], 0
        for batch in batches:
            for id_, path, own in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "words"))):
                items.append((path, id_, np.array(own, dtype="<i4").tobytes()))
                size += len(path) + 40
                if size > RUN:
                    yield from cut(items)
                    items, size = [], 0
        yield from cut(items)

    return run


class _Open:
    """A node of the current path."""

    __slots__ = ("words", "edge", "ends", "convs", "least", "children", "leaves", "saved", "below")

    def __init__(self, words: int, edge: bool) -> None:
        self.words, self.edge = words, edge
        self.ends: list[int] = []
        self.convs = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.below: list[tuple] = []  # finished children that wait for this node's least conversation

    def meets(self, convs: int, least: int) -> None:
        self.convs += convs
        self.least = least if self.least is None else min(self.least, least)


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _name(path: bytes, depth: int) -> bytes:
    return hashlib.md5(path[: depth * STEP]).digest()


def _nodes(part: int, runs: list[Run]) -> list[tuple]:
    """The rows (of _MERGED) of a range: finished nodes, those that wait for an edge node above, and edge nodes."""
    out: list[tuple] = []
    stack: list[_Open] = []
    path = b""

    def finish() -> None:
        depth, node = len(stack) - 1, stack.pop()
        up = stack[-1] if stack else None
        node.meets(len(node.ends), node.ends[0]) if node.ends else None
        if node.edge:
            name, above = _name(path, depth), _name(path, depth - 1) if up else None
            out.extend((_WAITING, part, None, name, None, None, *row[:2], None, *row[2:]) for row in node.below)
            ends = np.array(node.ends, dtype="<i8").tobytes() if node.ends else None
            out.append((_EDGE, part, name, above, node.words, ends, node.least, depth, None, node.convs, node.children, node.leaves, node.saved, None))
            if up:
                up.meets(node.convs, node.least)
            return
        node.saved += (node.convs - 1) * node.words
        node.leaves += not node.children
        out.extend((_DONE, part, None, None, None, None, *row[:2], node.least, *row[2:]) for row in node.below)
        up.below.append((node.least, depth, node.convs, node.children, node.leaves, node.saved, _digest(node.ends)))
        up.meets(node.convs, node.least)
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + node.leaves, up.saved + node.saved

    for item in merge(runs):
        first = not stack
        if first:
            stack.append(_Open(0, True))
        while len(stack) - 1 > item.lcp:
            finish()
        stack.extend(_Open(w, first) for w in item.weights[item.lcp - item.first :].tolist())
        stack[-1].ends.append(item.id)
        path = item.steps
    for node in stack:
        node.edge = True
    while stack:
        finish()
    return out


def _merged(rows: pa.Table) -> pa.Table:
    runs = [Run(*x) for x in zip(*(rows.column(c).to_pylist() for c in Run._fields))]
    made = _nodes(rows.column("part")[0].as_py(), runs)
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names = [f.split() for f in _MERGED.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*made), names)], names=[n for n, _ in names])


_RESOLVED = "node binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _resolve(rows: pa.Table) -> pa.Table:
    """Edge nodes with what is below them, deepest first. They are two paths for each range at most."""
    nodes = {r["node"]: r for r in rows.to_pylist()}
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
        r["n_leaves"] += not r["n_children"]
        if up := nodes.get(r["parent"]):
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
    for r in nodes.values():
        r["parent_conv_id"] = nodes[r["parent"]]["conv_id"] if r["parent"] else None
    names = [f.split()[0] for f in _RESOLVED.split(", ")]
    return pa.table([pa.array([r[n] for r in nodes.values()], pa.binary() if n == "node" else pa.int64()) for n in names], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node's ids in order of ranges, through one hash: no list of them is held."""
    node, hasher = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([hasher.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        for name, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            ids = ",".join(map(str, np.frombuffer(ends, "<i8").tolist())).encode()
            if name == node:
                hasher.update(b"," + ids)
                continue
            if hasher:
                yield row()
            node, hasher = name, hashlib.sha256(ids)
    if hasher:
        yield row()


def trie(paths: DataFrame, parts: int | None = None) -> DataFrame:
    """A row (``NODE``) for each node of the trie of ``paths`` (conv_id, path, words); conv_ids are unique.

    ``parts`` is the number of ranges (by default from the bytes of the paths). Equal
    paths end in the same node; an empty path ends in the root. No paths, no rows.
    """
    paths = settle(paths)
    width = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not parts:
        size = paths.agg(F.sum(F.octet_length("path") + 40)).first()[0] or 0
        parts = max(1, min(-(-size // RANGE[0]), width), -(-size // RANGE[1]))
    runs = paths.mapInArrow(_runs(_splitters(paths, parts)), _RUN)
    merged = settle(runs.groupBy("part").applyInArrow(_merged, _MERGED))
    names = [f.split()[0] for f in NODE.split(", ")]
    edges = merged.where(f"kind = {_EDGE}")
    added = edges.groupBy("node", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in _COUNTS))
    resolved = settle(added.groupBy(F.lit(0).alias("all")).applyInArrow(lambda rows: _resolve(rows), _RESOLVED))
    digests = edges.where("ends IS NOT NULL").select("node", "part", "ends").repartition("node").sortWithinPartitions("node", "part").mapInArrow(_digests, "node binary, ends_sha256 string")
    edge = resolved.join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_digest([]))))
    above = edges.select("part", "node").join(resolved.select("node", F.col("conv_id").alias("above")), "node").withColumnRenamed("node", "parent")
    waiting = merged.where(f"kind = {_WAITING}").drop("parent_conv_id").join(above, ["part", "parent"]).withColumnRenamed("above", "parent_conv_id")
    return merged.where(f"kind = {_DONE}").select(names).union(waiting.select(names)).union(edge.select(names))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations.

    A null role or text is empty; a null turn comes first; equal turns of a conversation are ordered by their hash, rows
    that repeat are turns of their own. Rows with a null conv_id are left out. Texts are whole, of any length. Extra
    columns are not read. No conversations, no nodes.
    """
    return trie(rebuilt(table(spark, folder, "conversations")))


_CRC32 = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""
ORACLE = rf"""
WITH t AS (SELECT conv_id AS c, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(struct_pack(h := h, w := w) ORDER BY turn NULLS FIRST, h) AS s FROM t GROUP BY c),
taken AS (SELECT c, s, ({_CRC32} % {HEADS})::BIGINT AS n FROM own),
seq AS (SELECT a.c, coalesce(b.s[1 : a.n], []) || a.s[a.n + 1 :] AS s FROM taken a LEFT JOIN own b ON b.c = a.c - a.c % {FAMILY}),
step AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seq),
pre AS (SELECT c, d, md5(array_to_string(list_transform(s[1 : d], lambda x: x.h), '')) AS id, md5(array_to_string(list_transform(s[1 : d - 1], lambda x: x.h), '')) AS up, d = len(s) AS ends, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w FROM step),
node AS (SELECT d, id, any_value(up) AS up, any_value(w) AS w, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS e FROM pre GROUP BY d, id),
kids AS (SELECT d - 1 AS d, up AS id, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (d, id)),
line AS (SELECT DISTINCT a.d AS ad, a.id AS aid, b.d, b.id FROM pre a JOIN pre b ON a.c = b.c AND b.d >= a.d),
below AS (SELECT ad AS d, aid AS id, count(*) FILTER (k = 0) AS leaves, sum((n - 1) * w) AS saved FROM line JOIN full_node USING (d, id) GROUP BY ad, aid)
SELECT a.c::BIGINT AS conv_id, a.d::BIGINT AS depth, p.c::BIGINT AS parent_conv_id, a.n::BIGINT AS n_convs, a.k::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(a.e) AS ends_sha256
FROM full_node a JOIN below USING (d, id) LEFT JOIN node p ON a.d > 0 AND p.d = a.d - 1 AND p.id = a.up
"""
