"""MinHash near-duplicates: DartMinHash signatures, banded joining, an exact check, classes.

Texts are bags of five-word shingles, each weighing as often as it occurs; two are
near-duplicates from a weighted Jaccard similarity (sum of the lesser weights over sum of
the greater ones) of 0.8. Where no shingle repeats that is the Jaccard similarity of sets.
The unit of work is a content (a sequence of words); rows with the same content
are one from the start and meet again only in the result. Shorter texts than five words
are near-duplicates of their own content alone, and all texts without a word are one class.

Contents that agree in a band meet in a bucket, and two are compared in the first band
that they share. A bucket of up to ``ALL_PAIRS`` contents compares all; a larger one holds
contents that look alike, and compares each with its
``LEADERS`` most central members (those that agree most with the bucket's commonest
coordinates) and with its neighbours in signature order. Buckets over ``BLOCK`` contents
are split, and the blocks' leaders meet in a further round until one block is left. That
puts most of a large bucket into one component with few pairs. The rest is exact: members
outside a large bucket's commonest component meet all its members of other components, a
block of the ones with a block of the others at a time, and are checked there, where their
shingles have come along; only links that join two components leave the task. So two
contents that share a band are in one class already or are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.batches import sliced
from tessera.llm.components import components
from tessera.llm.darts import signatures
from tessera.llm.shared import documents, settle, table, whole
from tessera.llm.wordhash import contents, mix, ranges, windows, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: 26 bands of 5 coordinates: of pairs at 0.8, 3 in 100,000 meet in none.
BANDS, ROWS = 26, 5
#: A pair goes on to the exact check from this share of equal coordinates (4 standard deviations below 0.8).
LIKELY = 0.66
ALL_PAIRS, LEADERS, NEIGHBOURS, BLOCK = 24, 4, 2, 2000
#: From this share of equal coordinates with the first leader a member of a large bucket needs no other link there.
SURE = 0.92
#: Bits of the filter by which texts are told apart before any is shuffled: 4 MB in bitmaps of 4 KB, however many texts there are.
SLOTS = 1 << 25

_U = np.uint64


def _shingles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a batch, their rows and how often they occur, the number of words of each row and its content."""
    hashes, first = word_hashes(batch.column("text"))
    at, found = windows(hashes, first, SHINGLE)
    row = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    times = np.diff(np.append(np.flatnonzero(new), len(found)))
    return found[new], row[new], times, np.diff(first), contents(hashes, first)


def _content(pairs: np.ndarray) -> pa.Array:
    return pa.array([p.tobytes() for p in np.ascontiguousarray(pairs)], pa.binary())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in sliced(whole):
            found, row, times, n_words, content = _shingles(batch)
            drawn = signatures(found, row, batch.num_rows, BANDS * ROWS, times)
            keys = ranges(mix(drawn.ravel() + _U(1)), *(lambda s: (s, s + ROWS))(np.arange(0, drawn.size, ROWS)), 0xD1342543DE82EF95)
            keys = (keys.reshape(-1, BANDS) + mix(np.arange(BANDS, dtype=np.uint64))).view(np.int64)
            short = n_words < SHINGLE
            sig = (drawn & _U(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    _content(content),
                    pa.array([None if s else x.tobytes() for s, x in zip(short, sig)], pa.binary()),
                    pa.array([None if s else x for s, x in zip(short, keys)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "content", "sig", "keys"],
            )


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, content, sig (a byte of each coordinate) and keys (of the bands); null sig and keys under five words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(_sign, f"doc_id {kind}, content binary, sig binary, keys array<bigint>")


def _pairs(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the pairs that a block compares, and its leaders (empty if all are compared)."""
    m = len(sig)
    if m <= ALL_PAIRS:
        a, b = np.triu_indices(m, 1)
        return a, b, np.zeros(0, dtype=np.int64)
    counts = np.zeros((sig.shape[1], 256), dtype=np.int64)
    np.add.at(counts, (np.arange(sig.shape[1])[None, :], sig), 1)
    central = (sig == counts.argmax(axis=1)[None, :].astype(np.uint8)).sum(axis=1)
    leaders = np.argsort(-central, kind="stable")[:LEADERS]
    others = np.setdiff1d(np.arange(m), leaders[:1])
    rest = others[(sig[others] == sig[leaders[0]]).mean(axis=1) < SURE]
    order = rest[np.lexsort(sig[rest].T[::-1])]
    a = [np.repeat(leaders[:1], len(others))] + [np.repeat(leaders[1:], len(rest))] + [order[:-k] for k in range(1, NEIGHBOURS + 1)]
    b = [others] + [np.tile(rest, len(leaders) - 1)] + [order[k:] for k in range(1, NEIGHBOURS + 1)]
    return np.concatenate(a), np.concatenate(b), leaders


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block) to candidate pairs (a, b) and, of split buckets, leaders (key, a).

    A pair is a candidate in the first band that it shares and in no other.
    """

    def block(key: int, split: bool, content: np.ndarray, sig: np.ndarray, keys: np.ndarray) -> None:
        a, b, leaders = _pairs(sig)
        likely = np.flatnonzero((sig[a] == sig[b]).mean(axis=1) >= LIKELY)
        a, b = a[likely], b[likely]
        first = keys[a, (keys[a] == keys[b]).argmax(axis=1)] == key
        for x, y in zip(content[a[first]], content[b[first]]):
            if x != y:
                out.append((None, min(x, y), max(x, y)))
        if split:
            out.extend((key, content[i], None) for i in (leaders if len(leaders) else range(len(sig))))

    def flush() -> pa.RecordBatch:
        made = list(dict.fromkeys(out))
        out.clear()
        columns = list(zip(*made)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["key", "a", "b"])

    out: list[tuple] = []
    for rows, edges in _grouped(batches):
        _blocks(rows, edges, block)
        yield flush()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by (key, block) in tables of whole groups, with the groups' edges."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        key, part = rows.column("key").to_numpy(), rows.column("block").to_numpy()
        edges = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        if not len(edges):
            continue
        yield rows.slice(0, int(edges[-1])), np.concatenate([[0], edges])
        held = rows.slice(int(edges[-1])).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, np.array([0, rows.num_rows])


def _blocks(rows: pa.Table, edges: np.ndarray, block) -> None:
    key, split = rows.column("key").to_numpy(), rows.column("blocks").to_numpy() > 1
    content = np.array(rows.column("content").to_pylist(), dtype=object)
    sig = _signatures(rows.column("sig"))
    keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    for s, e in zip(edges[:-1], edges[1:]):
        if e - s > 1 or split[s]:
            block(int(key[s]), bool(split[s]), content[s:e], sig[s:e], keys[s:e])


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block) to links (a, b) of an asking member and one at home in the block.

    A pair of two labels that looks alike is checked in full; a link joins their labels, so
    that a block gives fewer links than it has labels.
    """
    for rows, edges in _grouped(batches):
        content, sig = np.array(rows.column("content").to_pylist(), dtype=object), _signatures(rows.column("sig"))
        label = np.array(rows.column("label").combine_chunks().dictionary_encode().indices)
        asks, home = rows.column("asks").to_numpy(), rows.column("home").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint32) for x in rows.column("shingles").to_pylist()]
        out: list[tuple[bytes, bytes]] = []
        for s, e in zip(edges[:-1], edges[1:]):
            here = label[s:e].copy()  # the labels as the block's own links join them
            asking, there = np.flatnonzero(asks[s:e]), np.flatnonzero(home[s:e])
            for k in range(0, len(asking), 32):
                some = asking[k : k + 32]
                equal = (sig[s + some][:, None, :] == sig[s + there][None, :, :]).sum(axis=2, dtype=np.uint16)
                for i, agree in zip(some, equal):
                    near = np.flatnonzero(agree >= LIKELY * BANDS * ROWS)
                    near = there[near[np.argsort(-agree[near].astype(np.int64), kind="stable")]]
                    while len(near := near[here[near] != here[i]]):
                        part, near = near[:64], near[64:]
                        for j in part[_alike(sets[s + i], [sets[s + j] for j in part])]:
                            if here[j] != here[i]:
                                out.append((min(content[s + i], content[s + j]), max(content[s + i], content[s + j])))
                                here[here == here[j]] = here[i]
        x, y = list(zip(*dict.fromkeys(out))) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["a", "b"])


def _alike(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Whether each of ``others`` has a similarity of SIMILARITY or more with ``one`` (sorted hashes, none empty)."""
    lengths = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    common = np.add.reduceat(one[at] == flat, np.cumsum(lengths) - lengths, dtype=np.int64)
    return common >= SIMILARITY * (len(one) + lengths - common)


def once_each(signed: DataFrame) -> DataFrame:
    """content, sig and keys of each content of five words or more."""
    return settle(signed.where("sig IS NOT NULL").groupBy("content").agg(F.first("sig").alias("sig"), F.first("keys").alias("keys")))


def _sizes(entries: DataFrame) -> DataFrame:
    return entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def _dealt(members: DataFrame) -> DataFrame:
    """``members`` with the number of blocks of their bucket (of n) and a block."""
    return members.withColumn("blocks", F.expr(f"cast(ceil(n / {BLOCK}) as int)")).withColumn(
        "block", F.pmod(F.xxhash64("content", "key"), F.col("blocks")).cast("int")
    )


def candidates(once: DataFrame, sizes: DataFrame) -> DataFrame:
    """Distinct pairs of contents (a < b) that share a band and look alike: all of small buckets, those with leaders and neighbours of large ones."""
    width = int(once.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = once.select("content", F.explode("keys").alias("key"))
    found = []
    while True:
        met = settle(
            _dealt(entries.join(sizes, "key"))
            .drop("n")
            .join(once, "content")
            .repartition(width, "key", "block")
            .sortWithinPartitions("key", "block", "content")
            .select("key", "block", "blocks", "content", "sig", "keys")
            .mapInArrow(_meet, "key bigint, a binary, b binary")
        )
        found.append(met.where("b IS NOT NULL").select("a", "b"))
        entries = met.where("b IS NULL").select(F.col("a").alias("content"), "key")
        if entries.isEmpty():
            break
        sizes = _sizes(entries)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


def remaining(docs: DataFrame, signed: DataFrame, once: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a < b) that join two components and share a large bucket.

    Members outside a bucket's commonest component ask all its blocks; buckets of one
    component have none left. A task sees a block of members that ask and one that is asked.
    """
    width = int(once.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = (
        once.select("content", F.explode("keys").alias("key"))
        .join(sizes.where(f"n > {ALL_PAIRS}"), "key")
        .join(labels.withColumnRenamed("node", "content"), "content", "left")
        .withColumn("label", F.coalesce("label", "content"))
    )
    members = settle(_dealt(members))
    shares = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("commonest"), F.count("*").alias("labels")).where("labels > 1")
    placed = settle(members.join(mixed, "key").select("key", "content", "label", "block", "blocks", F.expr("label <> commonest").alias("roams")))
    sets = shingle_sets(docs, signed, placed.select("content").distinct())
    at = F.explode(
        F.expr(
            "array_union(transform(sequence(0, blocks - 1), x -> struct(block AS asked, x AS asking)), "
            "if(roams, transform(sequence(0, blocks - 1), x -> struct(x AS asked, block AS asking)), array()))"
        )
    )
    return (
        placed.join(once.select("content", "sig"), "content")
        .join(sets, "content")
        .withColumn("at", at)
        .select("key", F.expr("at.asked * blocks + at.asking").cast("int").alias("block"), "content", "sig", "label", "shingles",
                F.expr("roams AND at.asking = block").alias("asks"), F.expr("at.asked = block").alias("home"))
        .repartition(width, "key", "block")
        .sortWithinPartitions("key", "block", "content")
        .mapInArrow(_across, "a binary, b binary")
        .distinct()
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents and their shingles as sorted 32-bit hashes; the second and later occurrences of a shingle are elements of their own."""
    for whole in batches:
        for batch in sliced(whole):
            found, row, times, _, content = _shingles(batch)
            nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            found, row = mix(np.repeat(found, times) + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), np.repeat(row, times)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            small = (found >> _U(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [_content(content), pa.array([np.sort(small[s:e]).tobytes() for s, e in zip(cut[:-1], cut[1:])], pa.binary())], names=["content", "shingles"]
            )


def shingle_sets(docs: DataFrame, signed: DataFrame, ids: DataFrame) -> DataFrame:
    """content and shingles of the contents in ``ids``, from one row of each."""
    chosen = signed.select("doc_id", "content").join(ids, "content").groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    texts = filtered(documents(docs), chosen, "doc_id")
    return settle(texts.select("text").mapInArrow(_sets, "content binary, shingles binary").join(ids, "content", "left_semi").dropDuplicates(["content"]))


def filtered(rows: DataFrame, wanted: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The ``rows`` whose key is in ``wanted``, and few others (a hash of theirs meets one of those); with left_anti all the rest. No row is shuffled."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)) + 1
    bucket, bit = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    bitmaps = wanted.select(bucket.alias("_of"), bit.alias("_bit")).repartition("_of").groupBy("_of").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return rows.join(F.broadcast(bitmaps), (bucket == F.col("_of")) & (byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0), how)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            a, b = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
            both = np.sort(np.concatenate([a, b]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(common >= SIMILARITY * (len(both) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def checked(docs: DataFrame, signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose bags of shingles (as 32-bit hashes) have a similarity of 0.8 or more."""
    sets = shingle_sets(docs, signed, pairs.select(F.col("a").alias("content")).union(pairs.select(F.col("b").alias("content"))).distinct())
    return settle(
        pairs.join(sets.select(F.col("content").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("content").alias("b"), F.col("shingles").alias("y")), "b")
        .mapInArrow(_check, "a binary, b binary")
    )


def joined(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, label): the components of the contents that have a near-duplicate."""
    once = once_each(signed)
    sizes = settle(_sizes(once.select(F.explode("keys").alias("key"))))
    links = checked(docs, signed, settle(candidates(once, sizes)))
    labels = components(links)
    if sizes.where(f"n > {ALL_PAIRS}").isEmpty():
        return labels
    late = settle(remaining(docs, signed, once, sizes, labels))
    return labels if late.isEmpty() else merged(labels, late)


def merged(labels: DataFrame, late: DataFrame) -> DataFrame:
    """``labels`` with the components that the ``late`` links join; a node without a label is its own component."""
    ends = late.select(F.col("a").alias("node")).union(late.select(F.col("b").alias("node"))).distinct()
    every = settle(labels.union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))))
    of_a, of_b = (every.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in "ab")
    joins = components(late.join(of_a, "a").join(of_b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    top = joins.select(F.col("node").alias("label"), F.col("label").alias("top"))
    return settle(every.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and representative for each row: class_id is the least doc_id of its class.

    A class is a component of the links between contents, with every row of each content.
    ``representative`` is true for the rows whose doc_id is the class_id. Texts without a
    word (null, empty) are one class; an empty table gives no rows.
    """
    signed = settle(sign(docs))
    labels = joined(docs, signed)
    # A row for each content from here to the last join: copies count once, however many there are.
    firsts = signed.groupBy("content").agg(F.min("doc_id").alias("first"))
    firsts = firsts.join(labels.withColumnRenamed("node", "content"), "content", "left").select("content", "first", F.coalesce("label", "content").alias("label"))
    firsts = settle(firsts)
    heads = firsts.groupBy("label").agg(F.min("first").alias("class_id"))
    of_content = firsts.join(heads, "label").select("content", "class_id")
    return signed.select("doc_id", "content").join(of_content, "content").select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("representative"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns of ``docs``, whatever they are called.

    Rows are told apart by id and text together, so rows without an id or with equal ids
    keep their own classes, and of rows that are equal in both one stays.
    """
    own = F.struct(F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")).alias("own")
    found = classes(docs.select(own.alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("own")).agg(F.count("*").alias("n"), F.bool_or("representative").alias("stays"))
    # Most rows are alone and stay: only the others, and those that the filter takes for others, are shuffled with their texts.
    others = settle(found.where("n > 1 OR NOT stays"))
    rows = docs.select(whole(docs), own)
    once = filtered(rows, others, "own").withColumn("nth", F.row_number().over(W.partitionBy("own").orderBy("own"))).where("nth = 1").select("row", "own")
    kept = once.join(others.where("NOT stays").select("own"), "own", "left_anti").select("row")
    return filtered(rows, others, "own", "left_anti").select("row").union(kept).select("row.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every document. Null and empty texts are one class; equal texts, and rows that repeat, share a class; its id is the least of its documents' (null ids after all others);
    very long texts are whole. Extra columns are not read. No rows for no documents.
    """
    return classes(table(spark, folder, "documents"))
