"""Line deduplication: lines that many documents share stay in one of them.

``index`` makes a table with a row for each shard of the line hashes: a minimal perfect
hash of the shard's distinct hashes, and by its numbers three compact arrays: a
fingerprint, the number of documents, and the largest doc_id. ``probe`` asks it:
documents lie in cells, a cell sends each of its distinct line hashes once, packed by
shard, the shard looks them up in its arrays and sends two bits back for each. So no line
and no text is joined; a line that a third of all documents hold costs a hash for each
cell, and a shard holds an equal share of the distinct hashes, however frequent.

A line's key is the line without the white space ([\\x20\\x09-\\x0D]) at both ends, A-Z in
lower case. Keys are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import perfect_hash
from tessera.llm.batches import sliced
from tessera.llm.shared import documents, table
from tessera.llm.wordhash import _BYTE, bounds, mix, ranges, raw

#: Code points of the shortest key that counts, and documents that make it a shared one.
LEAST, SHARED = 20, 3
#: Bytes of text for each shard and each cell: from the first number, while one shard and eight cells for each partition
#: of the shuffle do, up to the second.
SHARD, CELL, CELLS = (4 << 20, 64 << 20), (1 << 20, 16 << 20), 8
#: Lines that a task counts before it sends what it has.
GATHER = 1 << 20

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NONE = np.iinfo(np.int64).min


def dealing(size: int, width: int) -> tuple[int, int]:
    """The number of shards and of cells for ``size`` bytes of text and ``width`` partitions."""
    return tuple(max(1, min(-(-size // least), width * times), -(-size // most)) for (least, most), times in ((SHARD, 1), (CELL, CELLS)))


def lines(column: pa.Array, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: starts and ends of all lines, the row of each, which lines have keys that count, and those keys' hashes."""
    data, offsets = raw(column)
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    row = np.repeat(np.arange(len(offsets) - 1), np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1)
    starts, ends, _ = bounds(data, offsets)
    one, past = np.searchsorted(starts, begin), np.searchsorted(ends, end, side="right")
    held = np.flatnonzero(past > one)
    low, high = starts[one[held]] if len(held) else held, ends[past[held] - 1] if len(held) else held
    if len(held):
        heads = np.append((data & 0xC0) != 0x80, False).view(np.uint8)
        points = np.add.reduceat(heads, np.stack([low, high], axis=1).ravel(), dtype=np.int64)[::2]
        long = points >= least
        held, low, high = held[long], low[long], high[long]
    return begin, end, row, held, ranges(_LOWER[data], low, high, _BYTE) if len(held) else np.zeros(0, dtype=np.uint64)


def _ids(column: pa.Array) -> np.ndarray:
    """Document ids as integers; a null id is the least."""
    return column.cast(pa.int64()).fill_null(_NONE).to_numpy(zero_copy_only=False)


def _tally(hashes: np.ndarray, row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, the number of rows that hold each, and the largest id of those."""
    order = np.lexsort((row, hashes))
    hashes, row = hashes[order], row[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))[: len(hashes)]
    return _sum(hashes[new], np.ones(int(new.sum()), dtype=np.int64), ids[row[new]])


def _sum(hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and largest ids of equal hashes together."""
    if not len(hashes):
        return hashes, counts, ids
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[first], np.add.reduceat(counts[order], first), np.maximum.reduceat(ids[order], first)


def _cuts(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, start, end) for the runs of sorted hashes that belong to one shard."""
    owner = ((hashes >> _U(32)) * _U(shards)) >> _U(32)
    edges = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(hashes)]
    return ((int(owner[s]), s, e) for s, e in zip(edges[:-1], edges[1:]) if e > s)


def _compact(counts: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _from(blobs: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype=kind)


_TALLY = "shard int, hashes binary, counts binary, ids binary"
INDEX = "shard int, n long, sizes binary, bits binary, fingerprints binary, counts binary, ids binary"


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5)) & _U(0xFFFFFFFF)).astype("<u4")


def index(docs: DataFrame, shards: int, least: int = LEAST, gather: int = GATHER) -> DataFrame:
    """The line index of ``docs``: a row for each shard that has hashes, of ``INDEX``.

    Each row of ``docs`` is a document of its own; one with a null id counts, and its id
    is less than any other. Null and empty texts have no keys; an empty table has an
    empty index. Tasks add up ``gather`` lines or more before they send anything.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            hashes, counts, ids = _sum(*(np.concatenate(x) for x in zip(*parts)))
            for shard, s, e in _cuts(hashes, shards):
                blobs = [hashes[s:e].astype("<u8").tobytes(), counts[s:e].astype("<i8").tobytes(), ids[s:e].astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names=["shard", "hashes", "counts", "ids"])

        for whole in batches:
            for batch in sliced(whole):
                _, _, row, held, hashes = lines(batch.column("text"), least)
                parts.append(_tally(hashes, row[held], _ids(batch.column("doc_id"))))
                size += len(parts[-1][0])
                if size > gather:
                    yield from send()
                    parts, size = [], 0
        if size:
            yield from send()

    def build(rows: pa.Table) -> pa.Table:
        hashes, counts, ids = _sum(_from(rows.column("hashes"), "<u8"), _from(rows.column("counts"), "<i8"), _from(rows.column("ids"), "<i8"))
        sizes, bits = perfect_hash.build(hashes)
        at = perfect_hash.number(hashes, sizes, bits)
        order = np.argsort(at)
        blobs = [sizes.astype("<i8").tobytes(), bits.tobytes(), _fingerprint(hashes[order]).tobytes(), _compact(counts[order]), ids[order].tobytes()]
        return pa.table([rows.column("shard")[:1], pa.array([len(hashes)], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], names=["shard", "n", "sizes", "bits", "fingerprints", "counts", "ids"])

    return documents(docs).mapInArrow(tally, _TALLY).groupBy("shard").applyInArrow(build, INDEX)


def _look_up(found: pa.Table, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of documents and the largest id of each hash by a shard's arrays; a hash that is not there has 0."""
    if not found.num_rows:
        return np.zeros(len(hashes), dtype=np.int64), np.full(len(hashes), _NONE)
    part = {c: found.column(c)[0].as_py() for c in found.column_names}
    at = perfect_hash.number(hashes, np.frombuffer(part["sizes"], "<i8"), np.frombuffer(part["bits"], np.uint8))
    known = (at >= 0) & (np.frombuffer(part["fingerprints"], "<u4")[at] == _fingerprint(hashes))
    counts = np.frombuffer(part["counts"], f"<u{len(part['counts']) // part['n']}")[at].astype(np.int64)
    return np.where(known, counts, 0), np.where(known, np.frombuffer(part["ids"], "<i8")[at], _NONE)


def _batch(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def probe(docs: DataFrame, index: DataFrame, shards: int, cells: int, shared: int = SHARED, least: int = LEAST, texts: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 for each row; with ``texts`` the kept text as well.

    Keys that the index counts in ``shared`` documents or more lose all their lines, but
    not in the rows with the largest id that holds them (rows that share that id all keep
    them, all repeats within a row too). A null or empty text is one empty line, which
    stays. A document of which no line stays has an empty text. Rows alike in id and text
    lie in one cell; a long text is whole in its cell. An empty table gives no rows.
    """
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = documents(docs).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text"), F.lit(cells)).cast("int")).repartition(width, "cell")

    def ask(rows: pa.Table) -> pa.Table:
        _, _, row, held, hashes = lines(_batch(rows, "text"), least)
        distinct, _, ids = _tally(hashes, row[held], _ids(_batch(rows, "doc_id")))
        made = [(shard, distinct[s:e].astype("<u8").tobytes(), ids[s:e].astype("<i8").tobytes()) for shard, s, e in _cuts(distinct, shards)]
        of, asked, largest = zip(*made) if made else ((), (), ())
        cell = [rows.column("cell")[0].as_py()] * len(made)
        return pa.table([pa.array(of, pa.int32()), pa.array(cell, pa.int32()), pa.array(asked, pa.binary()), pa.array(largest, pa.binary())], names=["shard", "cell", "hashes", "ids"])

    def answer(rows: pa.Table, found: pa.Table) -> pa.Table:
        """Two bits for each hash of each cell: it is shared; the cell has the document that keeps it."""
        blobs = []
        for hashes, ids in zip(rows.column("hashes").to_pylist(), rows.column("ids").to_pylist()):
            counts, largest = _look_up(found, np.frombuffer(hashes, "<u8"))
            own = np.frombuffer(ids, "<i8")
            blobs.append(np.packbits(np.stack([counts >= shared, own >= largest])).tobytes())
        return pa.table([rows.column("cell").cast(pa.int32()), rows.column("shard").cast(pa.int32()), pa.array(blobs, pa.binary())], names=["cell", "shard", "bits"])

    def drop(rows: pa.Table, back: pa.Table) -> pa.Table:
        column, ids = _batch(rows, "text"), _ids(_batch(rows, "doc_id"))
        begin, end, row, held, hashes = lines(column, least)
        distinct, _, own = _tally(hashes, row[held], ids)
        common, keeps = np.zeros(len(distinct), dtype=bool), np.zeros(len(distinct), dtype=bool)
        answers = dict(zip(back.column("shard").to_pylist(), back.column("bits").to_pylist()))
        for shard, s, e in _cuts(distinct, shards):
            common[s:e], keeps[s:e] = np.unpackbits(np.frombuffer(answers[shard], np.uint8), count=2 * (e - s)).reshape(2, -1).astype(bool)
        place = np.searchsorted(distinct, hashes)
        gone = np.zeros(len(begin), dtype=bool)
        gone[held] = common[place] & ~(keeps[place] & (ids[row[held]] == own[place]))
        n_lines, n_dropped = np.bincount(row, minlength=len(ids)), np.bincount(row[gone], minlength=len(ids))
        first = np.concatenate([[0], np.cumsum(n_lines)])
        data, offsets = raw(column)
        digests, kept = [], []
        for i, n in enumerate(n_dropped.tolist()):
            if n:
                own_lines = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                text = b"\n".join([data[s:e].tobytes() for s, e in zip(begin[own_lines].tolist(), end[own_lines].tolist())])
            else:
                text = data[offsets[i] : offsets[i + 1]].tobytes()
            digests.append(hashlib.sha256(text).hexdigest())
            if texts:
                kept.append(text.decode("utf-8", "replace"))
        out = [rows.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())]
        return pa.table(out + [pa.array(kept, pa.string())] * texts, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"] + ["kept_text"] * texts)

    asked = dealt.groupBy("cell").applyInArrow(ask, "shard int, cell int, hashes binary, ids binary")
    bits = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(answer, "cell int, shard int, bits binary")
    schema = f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * texts
    return dealt.groupBy("cell").cogroup(bits.groupBy("cell")).applyInArrow(drop, schema)


def dedup(docs: DataFrame, shared: int = SHARED, least: int = LEAST, texts: bool = False) -> DataFrame:
    """``docs`` asked by an index of their own; what ``probe`` says of nulls, repeated rows and empty tables holds."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards, cells = dealing(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, width)
    return probe(docs, index(docs, shards, least), shards, cells, shared, least, texts)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document: its lines, those dropped and a digest of what stays.

    Null and empty texts: one line, none dropped. Rows that repeat an id, and rows alike, are documents of their
    own; null ids are less than all. Very long texts are whole. Extra columns are not read. No rows for no documents.
    """
    return dedup(table(spark, folder, "documents"))


_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
keyed AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
common AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= {LEAST} GROUP BY k HAVING count(DISTINCT r) >= {SHARED}),
marked AS (SELECT r, i, line, top IS NOT NULL AND doc_id < top AS gone FROM keyed LEFT JOIN common USING (k)),
kept AS (SELECT r, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS t FROM marked GROUP BY r)
SELECT doc_id, len(l)::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM d JOIN kept USING (r)
"""
