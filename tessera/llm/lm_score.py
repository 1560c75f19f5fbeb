"""Language-model scores of documents: a byte PPM trained on the corpus, beside a smoothed word model.

A pass over the documents makes slices: some documents with their texts, the slice's
distinct byte windows and its distinct words, each with how often training texts have it.
Windows and words go to parts by a hash, of which there are as many as the size of the
texts asks for. A part adds the slices' counts up and answers each slice in its own order:
counts of words, and probabilities of windows that training has seen. The rest, windows of
held-out texts alone, goes down the trie's levels, each dealt by a hash of its own shorter
context, until its symbol is found. The whole trie is in the parts and grows with the
corpus; only the nodes of the two lowest orders, at most 65,792, are sent to executors.
Answers come back to the slices, where documents are scored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import sliced
from tessera.llm.ppm import END, ORDER, Asked, Level, counted, mask, normal, pieces, resolve, unseen
from tessera.llm.shared import documents, settle, shared_folder, table
from tessera.llm.wordhash import mix, word_hashes

#: A document is held out if crc32 of its id as text leaves 0; one without an id is not.
FOLDS = 10
#: Bytes of normal text in a slice (a longer text is a slice of its own), and bytes of text for each part.
SLICE, PART = 12 << 20, 16 << 20
#: Small tables have parts of at least so many bytes, as far as there are cores for them.
SMALL = 1 << 20

_U = np.uint64


def held_out(ids: list) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids], dtype=bool)


def _small(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _large(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of as many bytes as the largest needs, which compress better than the numbers in a row."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + _small(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_large(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def _floats(data: bytes) -> np.ndarray:
    return np.frombuffer(_large(data), "<f8")


def _rounded(logs: np.ndarray) -> np.ndarray:
    """Logs of probabilities in steps of 2**-20, from 1; 0 where there is none."""
    return np.where(np.isnan(logs), 0, np.minimum(np.rint(-logs * 2.0**20), 2.0**24 - 2) + 1).astype(np.uint64)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mix(hashes) % _U(parts)).astype(np.int64)


def _dealt(part: np.ndarray, parts: int) -> list[np.ndarray]:
    """For each part the places of its values, in their order."""
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, parts)))


def _context(windows: np.ndarray, order: int) -> np.ndarray:
    """The context of ``order`` bytes; all its windows of that order go to one part."""
    return (windows & mask(order)) >> _U(8)


def _lower(batch: pa.RecordBatch) -> list[bytes]:
    return [normal(t or b"") for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def _words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words and each text's first index, of about a megabyte of texts at a time (a longer text comes alone)."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= 1 << 20:
            yield word_hashes(pa.array(held, pa.large_binary()))
            held, n = [], 0
    if held:
        yield word_hashes(pa.array(held, pa.large_binary()))


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the place of each value among them."""
    distinct, place = np.unique(values, return_inverse=True)
    return distinct, place.astype(np.uint32)


class _Counts:
    """Distinct values and their training counts, gathered and added up now and then."""

    def __init__(self):
        self.values, self.counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def add(self, values: np.ndarray, train: bool) -> None:
        v, c = np.unique(values, return_counts=True)
        self.values.append(v)
        self.counts.append(c if train else np.zeros(len(c), np.int64))
        if len(self.values) > 5:
            v, c = self.all()
            self.values, self.counts = [v], [c]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return counted(np.concatenate(self.values), np.concatenate(self.counts))


def gather(docs: DataFrame, parts: int) -> DataFrame:
    """Slices of ``docs``: a row of kind 'text' for each, and rows of kinds 'windows' and 'words' for the parts it has any of."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, id_arrow = [], [], 0, None

        def flush() -> pa.RecordBatch:
            name, out = uuid.uuid4().hex, held_out(ids)
            windows, words = _Counts(), _Counts()
            for train in (True, False):
                some = [t for t, o in zip(texts, out) if o != train]
                for found, _, _ in pieces(some):
                    windows.add(found, train)
                for hashes, _ in _words(some):
                    words.add(hashes, train)
            rows = [("text", None, name, int((~out).sum()), _small(b"".join(texts)), None, list(ids))]
            for kind, gathered in (("windows", windows), ("words", words)):
                values, counts = gathered.all()
                part = _part(values >> _U(8) if kind == "windows" else values, parts)
                rows += [(kind, p, name, 0, _packed(values[at]), _packed(counts[at]), None) for p, at in enumerate(_dealt(part, parts)) if len(at)]
            ids.clear(), texts.clear()
            types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(id_arrow))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=["kind", "part", "slice", "n", "a", "b", "ids"])

        for whole in batches:
            for batch in sliced(whole):
                id_arrow = batch.column("doc_id").type
                for i, t in zip(batch.column("doc_id").to_pylist(), _lower(batch)):
                    if texts and size + len(t) > SLICE:
                        yield flush()
                        size = 0
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
        if texts:
            yield flush()

    return documents(docs).mapInArrow(run, f"kind string, part int, slice string, n bigint, a binary, b binary, ids array<{id_type}>")


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"kind": pa.string(), "slice": pa.string(), "part": pa.int32(), "n": pa.int64(), "m": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(list(c), kinds[n]) for c, n in zip(columns, names)], names=names)


_ROWS = "kind string, slice string, part int, a binary, b binary, c binary"
_NAMES = ["kind", "slice", "part", "a", "b", "c"]


def _down(order: int, level: Level, asked: Asked, parts: int) -> list[tuple]:
    """Rows for the parts of the next shorter ``order``: this level's nodes there, and the windows that ask."""
    rows = []
    keys, counts = counted(level.keys & mask(order), level.counts.astype(np.int64))
    if order > 1:
        for p, at in enumerate(_dealt(_part(keys >> _U(8), parts), parts)):
            if len(at):
                rows.append(("node", None, p, _packed(keys[at]), _packed(counts[at]), None))
    elif len(keys):
        rows.append(("node", None, 0, _packed(keys), _packed(counts), None))
    if len(asked.windows):
        for p, at in enumerate(_dealt(_part(_context(asked.windows, order), parts), parts)):
            if len(at):
                some = asked[at]
                rows.append(("ask", None, p, _packed(some.windows), _small(some.cost.astype("<f8").tobytes()), _small(some.excluded.tobytes())))
    return rows


def _asking(rows: pa.Table) -> Asked:
    held = [r for r in rows.select(["kind", "a", "b", "c"]).to_pylist() if r["kind"] == "ask"]
    if not held:
        return Asked(np.zeros(0, np.uint64))
    return Asked(
        np.concatenate([_unpacked(r["a"]) for r in held]), np.concatenate([_floats(r["b"]) for r in held]),
        np.concatenate([np.frombuffer(_large(r["c"]), np.uint8).reshape(-1, 32) for r in held]),
    )


def _found(windows: np.ndarray, logs: np.ndarray, parts: int) -> list[tuple]:
    """Rows of kind 'found' for the parts of the highest order, where the slices have asked."""
    return [
        ("found", None, p, _packed(windows[at]), _small(logs[at].astype("<f8").tobytes()), None)
        for p, at in enumerate(_dealt(_part(windows >> _U(8), parts), parts)) if len(at)
    ]


def probabilities(windows: DataFrame, parts: int) -> DataFrame:
    """slice, part, kind, a and b: log10 probabilities of each slice's windows of each part.

    Kind 'seen' has a number for each window in the slice's order, to 2**-20 (none where training
    has not seen it), kind 'late' has the windows of the others and their numbers.
    """

    def highest(rows: pa.Table) -> pa.Table:
        slices, part = rows.column("slice").to_pylist(), rows.column("part")[0].as_py()
        each = [_unpacked(a) for a in rows.column("a").to_pylist()]
        values, counts = counted(np.concatenate(each), np.concatenate([_unpacked(b) for b in rows.column("b").to_pylist()]).astype(np.int64))
        level = Level(values[counts > 0], counts[counts > 0])
        logs = np.full(len(values), np.nan)
        logs[counts > 0] = level.seen()
        asked = Asked(values[counts == 0])
        _, _, asked = resolve(asked, ORDER, level)
        out = _down(ORDER - 1, level, asked, parts)
        for name, own in zip(slices, each):
            answer = logs[np.searchsorted(values, own)]
            out.append(("seen", name, part, None, _packed(_rounded(answer)), None))
            late = np.isnan(answer)
            if late.any():
                out.append(("late", name, part, _packed(own[late]), None, None))
        return _table(out, _NAMES)

    def lower(order: int):
        def run(rows: pa.Table) -> pa.Table:
            held = [r for r in rows.select(["kind", "a", "b"]).to_pylist() if r["kind"] == "node"]
            none = [np.zeros(0, np.uint64)]
            level = Level(*counted(np.concatenate([_unpacked(r["a"]) for r in held] or none), np.concatenate([_unpacked(r["b"]) for r in held] or none).astype(np.int64)))
            got, logs, left = resolve(_asking(rows), order, level)
            return _table(_found(got, logs, parts) + _down(order - 1, level, left, parts), _NAMES)

        return run

    rows = settle(windows.repartition(parts, "part").groupBy("part").applyInArrow(highest, _ROWS))
    first, found = rows, []
    for order in range(ORDER - 1, 1, -1):
        rows = settle(rows.where("kind IN ('node', 'ask')").repartition(parts, "part").groupBy("part").applyInArrow(lower(order), _ROWS))
        found.append(rows.where("kind = 'found'"))
    # What is left of the nodes is at most 65,536 rows, summed before they come to the driver.
    one = rows.where("kind = 'node'").select("a", "b").mapInArrow(_rows, "v bigint, n bigint").groupBy("v").agg(F.sum("n").alias("n"))
    low = [(r["v"], r["n"]) for r in one.orderBy("v").toLocalIterator()]
    keys, counts = np.array([v for v, _ in low], np.uint64), np.array([n for _, n in low], np.int64)
    one, zero = Level(keys, counts), Level(*counted(keys & mask(0), counts))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, out = _asking(pa.Table.from_batches([batch])), []
            for order, level in ((1, one), (0, zero)):
                got, logs, left = resolve(left, order, level)
                out += _found(got, logs, parts)
            out += _found(left.windows, left.cost + unseen(zero), parts)
            yield from _table(out, _NAMES).combine_chunks().to_batches()

    found.append(rows.where("kind = 'ask'").mapInArrow(last, _ROWS))
    answers = found[0]
    for more in found[1:]:
        answers = answers.union(more)

    def sent(asked: pa.Table, got: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _table([], _NAMES)
        values = np.concatenate([_unpacked(a) for a in got.column("a").to_pylist()])
        logs = np.concatenate([_floats(b) for b in got.column("b").to_pylist()])
        order = np.argsort(values)
        values, logs, out = values[order], logs[order], []
        for name, part, a in zip(*(asked.column(c).to_pylist() for c in ("slice", "part", "a"))):
            out.append(("late", name, part, a, _small(logs[np.searchsorted(values, _unpacked(a))].astype("<f8").tobytes()), None))
        return _table(out, _NAMES)

    late = first.where("kind = 'late'").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(sent, _ROWS)
    return first.where("kind = 'seen'").union(late).select("kind", "slice", "part", "a", "b")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(_unpacked(a).astype(np.int64)), pa.array(_unpacked(b).astype(np.int64))], names=["v", "n"])


def frequencies(words: DataFrame, parts: int) -> DataFrame:
    """slice, part, kind 'count' and the training counts of each slice's words, with n and m, the part's distinct and all training words (in one row)."""

    def count(rows: pa.Table) -> pa.Table:
        each = [_unpacked(a) for a in rows.column("a").to_pylist()]
        values, counts = counted(np.concatenate(each), np.concatenate([_unpacked(b) for b in rows.column("b").to_pylist()]).astype(np.int64))
        back = [_packed(counts[np.searchsorted(values, own)]) for own in each]
        n, m = [int((counts > 0).sum())] + [0] * (len(back) - 1), [int(counts.sum())] + [0] * (len(back) - 1)
        return pa.table([rows.column("slice"), rows.column("part"), pa.array(back, pa.binary()), pa.array(n), pa.array(m)], names=["slice", "part", "b", "n", "m"])

    return settle(words.repartition(parts, "part").groupBy("part").applyInArrow(count, "slice string, part int, b binary, n bigint, m bigint"))


def _answers(values: np.ndarray, part: np.ndarray, parts: int, rows: list[dict]) -> np.ndarray:
    """What the parts have said of a slice's values."""
    out, at = np.zeros(len(values)), _dealt(part, parts)
    for r in rows:
        if r["kind"] == "seen":
            out[at[r["part"]]] = (1.0 - _unpacked(r["b"]).astype(np.float64)) * 2.0**-20
        elif r["kind"] == "count":
            out[at[r["part"]]] = _unpacked(r["b"])
    for r in rows:
        if r["kind"] == "late":
            out[np.searchsorted(values, _unpacked(r["a"]))] = _floats(r["b"])
    return out


def scores(docs: DataFrame) -> DataFrame:
    """The columns of the contract for each row; rows with equal ids and words have equal values.

    Null and empty texts are their end alone; repeated rows are learned from as often as
    they occur. An empty table gives no rows. A slice holds one text whole, whatever its length.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART), min(spark.sparkContext.defaultParallelism, size // SMALL))
    path = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    made = gather(docs, parts)
    made.write.partitionBy("kind").option("compression", "snappy").parquet(path)
    gathered = spark.read.schema(made.schema).parquet(path)
    counts = frequencies(gathered.where("kind = 'words'"), parts)
    sums = counts.agg(F.sum("n"), F.sum("m")).first()
    texts = gathered.where("kind = 'text'").select("slice", "ids", "a", "n")
    ends = texts.agg(F.sum("n")).first()[0] or 0  # an end for each training document
    total = (sums[1] or 0) + ends
    whole = np.log10(total + 0.1 * ((sums[0] or 0) + (1 if ends else 0) + 1))
    answers = probabilities(gathered.where("kind = 'windows'"), parts).union(counts.selectExpr("'count' AS kind", "slice", "part", "cast(NULL AS binary) AS a", "b"))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    width = max(spark.sparkContext.defaultParallelism, -(-size // SLICE))  # what a task reads doesn't grow with the table

    def score(own: pa.Table, back: pa.Table) -> pa.Table:
        out, rows = [], back.to_pylist()
        for ids, data in zip(own.column("ids").to_pylist(), own.column("a").to_pylist()):
            texts_ = [t + END for t in _large(data).split(END)[:-1]]
            held = [(*_places(found), text, first) for found, text, first in pieces(texts_)]
            values = _distinct(np.concatenate([x[0] for x in held]))
            logs = _answers(values, _part(values >> _U(8), parts), parts, [r for r in rows if r["kind"] != "count"])
            model = np.zeros(len(texts_))
            while held:
                distinct, place, text, first = held.pop()
                np.add.at(model, text, np.add.reduceat(logs[np.searchsorted(values, distinct)][place], first))
            told = [(*_places(hashes), first) for hashes, first in _words(texts_)]
            values = _distinct(np.concatenate([x[0] for x in told]))
            counted_ = _answers(values, _part(values, parts), parts, [r for r in rows if r["kind"] == "count"])
            sums_ = []
            for distinct, place, first in told:
                c, n = counted_[np.searchsorted(values, distinct)], np.diff(first)
                some = np.flatnonzero(n)
                base, known = np.zeros(len(n)), np.zeros(len(n), np.int64)
                if len(some):
                    base[some] = np.add.reduceat(np.log10(c + 0.1)[place], first[:-1][some])
                    known[some] = np.add.reduceat((c > 0).astype(np.int64)[place], first[:-1][some])
                sums_.append((n + 1, known, base))
            tokens, known, base = (np.concatenate(x) for x in zip(*sums_))
            out.append((ids, held_out(ids), tokens, known + (1 if ends else 0), base + np.log10(ends + 0.1) - tokens * whole, model))
        if not out:
            return _empty
        ids = [i for o in out for i in o[0]]
        held, tokens, known, base, model = (np.concatenate([o[k] for o in out]) for k in range(1, 6))
        columns = [pa.array(ids, own.schema.field("ids").type.value_type), pa.array(held), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)),
                   pa.array(np.full(len(ids), total, np.int64)), pa.array(base), pa.array(model)]
        return pa.table(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    _empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return texts.repartition(width, "slice").groupBy("slice").cogroup(answers.repartition(width, "slice").groupBy("slice")).applyInArrow(score, schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """A score for every document. Null and empty texts are one end; rows that repeat have equal scores; null ids are training rows; very long texts are whole. Extra columns
    are not read. No rows for no documents.
    """
    return scores(table(spark, folder, "documents"))
