"""Substring deduplication: words covered by a window of 35 words that starts anywhere else too.

Windows are found by difference-cover anchors. D = {0, 1, 3, 9} has every difference
modulo 13, so whatever places two equal windows start at, some shift below 13 puts both
on cover positions; there they have an anchor of 35 - 12 = 23 words in common. Only the
anchors at cover positions are hashed and compared (4 of 13 positions). A window with a
repeated anchor is a candidate and is extended: the full window's hash is compared with
those of the other candidates, so a window counts exactly if its 35 words (as 64-bit
hashes) occur twice.

Documents are dealt into cells by a hash. A cell sends each of its distinct hashes once,
packed by hash range, and gets back a bit for each: whether another cell has it too. So a
passage that a third of all documents share costs a hash for each cell, no pairs are
made, and no text moves but once, into its cell.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import documents, table
from tessera.llm.wordhash import bounds, ranges, raw, windows, word_hashes, _BYTE

WINDOW = 35
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text in a cell, and for each range of hashes: from the first number, while 16 cells and one range
#: for each partition of the shuffle do, up to the second, whatever the number of partitions. So a task holds a bounded
#: cell or range at a time; a cell and a range have a row between them only if they share a hash, so rows never outnumber hashes.
CELL, RANGE, CELLS = (1 << 20, 8 << 20), (16 << 20, 64 << 20), 16
#: Bytes of a hash that travel: false repeats of anchors only make candidates, windows are sent in full.
ANCHOR_BYTES, WINDOW_BYTES = 6, 8

_U = np.uint64


def _top(hashes: np.ndarray, width: int) -> np.ndarray:
    return hashes >> _U(64 - 8 * width)


def _range_of(distinct: np.ndarray, width: int, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges each of the sorted hashes belongs to, in order."""
    return ((distinct >> _U(8 * width - 32)) * _U(parts)) >> _U(32)


def _send(cell: int, kind: int, hashes: np.ndarray, width: int, parts: int) -> list[tuple]:
    """Rows (part, kind, cell, blob) with the distinct hashes of a cell; a range without any has no row."""
    distinct = np.unique(_top(hashes, width))
    if not len(distinct):
        return []
    owner = _range_of(distinct, width, parts)
    cuts = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(distinct)]
    packed = np.ascontiguousarray(distinct.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return [(int(owner[s]), kind, cell, packed[s:e].tobytes()) for s, e in zip(cuts[:-1], cuts[1:])]


def _received(rows: pa.Table, kind: int, hashes: np.ndarray, width: int, parts: int) -> np.ndarray:
    """Whether each of ``hashes`` occurs again, in the cell or (by the bits that came back) in another."""
    distinct, place, counts = np.unique(_top(hashes, width), return_inverse=True, return_counts=True)
    again = counts > 1
    owner = _range_of(distinct, width, parts)
    for k, part, bits in zip(rows.column("kind").to_pylist(), rows.column("part").to_pylist(), rows.column("bits").to_pylist()):
        if k == kind:
            s, e = np.searchsorted(owner, _U(part), "left"), np.searchsorted(owner, _U(part), "right")
            again[s:e] |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=e - s).astype(bool)
    return again[place]


def _anchors(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the anchors at cover positions, counted from each row's first word."""
    at, found = windows(hashes, first, ANCHOR)
    row_start = first[np.searchsorted(first, at, side="right") - 1]
    covered = np.isin((at - row_start) % PERIOD, COVER)
    return at[covered], found[covered]


def _candidates(hashes: np.ndarray, first: np.ndarray, back: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that hold a repeated anchor."""
    at, found = _anchors(hashes, first)
    if not len(at):
        return at, found
    marks = np.zeros(len(hashes) + PERIOD + 1, dtype=np.int64)
    marks[at[_received(back, 0, found, ANCHOR_BYTES, parts)] + 1] = 1
    upto = np.cumsum(marks)
    starts, whole = windows(hashes, first, WINDOW)
    held = upto[starts + PERIOD] > upto[starts]
    return starts[held], whole[held]


def _blobs(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["part", "kind", "cell", "blob"])


def _compare(rows: pa.Table) -> pa.Table:
    """A part's blobs to bits: for each hash of each blob, whether another cell's blob has it."""
    blobs = rows.column("blob").to_pylist()
    kinds = rows.column("kind").to_pylist()
    width = ANCHOR_BYTES if kinds[0] == 0 else WINDOW_BYTES
    lengths = np.array([len(b) // width for b in blobs])
    packed = np.zeros((int(lengths.sum()), 8), dtype=np.uint8)
    packed[:, :width] = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, width)
    values = packed.view("<u8").ravel()
    order = np.argsort(values)
    ordered = values[order]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(len(values), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    ends = np.cumsum(lengths)
    bits = [np.packbits(again[e - n : e]).tobytes() for n, e in zip(lengths, ends)]
    return pa.table([rows.column("cell").cast(pa.int64()), rows.column("kind").cast(pa.int32()), rows.column("part").cast(pa.int32()), pa.array(bits, pa.binary())], names=["cell", "kind", "part", "bits"])


_BLOB = "part int, kind int, cell bigint, blob binary"
_BITS = "cell bigint, kind int, part int, bits binary"


def _text(rows: pa.Table) -> pa.Array:
    column = rows.column("text").combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def dealing(size: int, width: int) -> tuple[int, int]:
    """The number of cells and of hash ranges for ``size`` bytes of text and ``width`` partitions."""
    return tuple(max(1, min(-(-size // least), width * times), -(-size // most)) for (least, most), times in ((CELL, CELLS), (RANGE, 1)))


def repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row; with ``texts`` the kept text as well.

    A null text has no words. Rows with equal ids or equal texts count as rows of their
    own: the windows of equal texts of 35 words or more are all repeats. Nothing shorter
    than a window is removed. An empty table gives no rows.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells, parts = dealing(size, width)
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = (
        documents(docs).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text"), F.lit(cells)).cast("long")).repartition(width, "cell")
    )

    def anchors(rows: pa.Table) -> pa.Table:
        cell = rows.column("cell")[0].as_py()
        return _blobs(_send(cell, 0, _anchors(*word_hashes(_text(rows)))[1], ANCHOR_BYTES, parts))

    def extended(rows: pa.Table, back: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _blobs([])
        cell = rows.column("cell")[0].as_py()
        return _blobs(_send(cell, 1, _candidates(*word_hashes(_text(rows)), back, parts)[1], WINDOW_BYTES, parts))

    def remove(rows: pa.Table, back: pa.Table) -> pa.Table:
        column = _text(rows)
        data, offsets = raw(column)
        starts, ends, first = bounds(data, offsets)
        hashes = ranges(data, starts, ends, _BYTE) if len(starts) else np.zeros(0, dtype=np.uint64)
        at, found = _candidates(hashes, first, back, parts)
        again = at[_received(back, 1, found, WINDOW_BYTES, parts)] if len(at) else at
        edge = np.zeros(len(hashes) + 1, dtype=np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + WINDOW, -1)
        gone = np.cumsum(edge)[:-1] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        n_removed = removed[first[1:]] - removed[first[:-1]]
        content, digests, kept_texts = data.tobytes(), [], []
        for i, n in enumerate(n_removed):
            if n:
                own = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                kept = b" ".join([content[s:e] for s, e in zip(starts[own].tolist(), ends[own].tolist())])
            else:
                kept = b" ".join(content[offsets[i] : offsets[i + 1]].split())
            digests.append(hashlib.sha256(kept).hexdigest())
            if texts:
                kept_texts.append(kept.decode("utf-8", "replace"))
        out = [rows.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        return pa.table(out + [pa.array(kept_texts, pa.string())] * texts, names=names + ["kept_text"] * texts)

    def answered(blobs: DataFrame) -> DataFrame:
        return blobs.groupBy("part").applyInArrow(_compare, _BITS)

    first_bits = answered(dealt.groupBy("cell").applyInArrow(anchors, _BLOB))
    second_bits = answered(dealt.groupBy("cell").cogroup(first_bits.groupBy("cell")).applyInArrow(extended, _BLOB))
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts
    return dealt.groupBy("cell").cogroup(first_bits.union(second_bits).groupBy("cell")).applyInArrow(remove, schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's words, and what is left of them. Null and empty texts have none; equal rows repeat each other's windows; long texts are whole. Extra columns are not read. No rows for no documents."""
    return repeats(table(spark, folder, "documents"))


ORACLE = rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, sha256(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
dup AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM win SEMI JOIN dup USING (s), range({WINDOW}) AS t(k)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""
