"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken for a whole batch in numpy. Trees are grown by histograms of
gradients over quantile bins and flattened into arrays of complete binary trees, so that
scoring is DEPTH rounds of array lookups for all documents and trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.batches import sliced
from tessera.llm.labelled import held_out, sample, sigmoid, with_texts
from tessera.llm.shared import documents, table
from tessera.llm.wordhash import _BYTE, bounds, ranges, raw, windows

FEATURES = (
    "log_words", "word_bytes", "long_words", "short_words", "capitals", "digits", "signs", "symbols", "bars", "exclamations",
    "beyond_ascii", "spaces", "distinct_words", "repeated_next", "repeated_windows", "repeated_lines", "log_lines", "line_words",
)
TREES, DEPTH, BINS, RATE, RIDGE = 60, 4, 64, 0.15, 1.0


def _class(test) -> np.ndarray:
    return np.array([test(chr(b)) if b < 128 else False for b in range(256)])


_CLASSES = {
    "capitals": _class(str.isupper), "digits": _class(str.isdigit), "signs": _class(lambda c: c.isprintable() and not c.isalnum() and c != " "),
    "symbols": _class(lambda c: c in "#*$%&|<>"), "bars": _class(lambda c: c == "|"), "exclamations": _class(lambda c: c == "!"),
    "beyond_ascii": np.arange(256) >= 128, "spaces": _class(str.isspace),
}


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; a text without words has zeros in place of means and shares."""
    data, offsets = raw(column)
    starts, ends, first = bounds(data, offsets)
    n_docs, n_words, n_bytes = len(column), np.diff(first).astype(np.float64), np.diff(offsets).astype(np.float64)
    doc = np.repeat(np.arange(n_docs), np.diff(first))

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=n_docs)

    def of_bytes(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return upto[offsets[1:]] - upto[offsets[:-1]]

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(len(b)), where=b > 0)

    def distinct(row: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(values):
            return np.zeros(n_docs)
        order = np.lexsort((values, row))
        r, v = row[order], values[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])])
        return np.bincount(r[new], minlength=n_docs).astype(np.float64)

    length = (ends - starts).astype(np.float64)
    hashes = ranges(data, starts, ends, _BYTE) if len(starts) else np.zeros(0, np.uint64)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    at, three = windows(hashes, first, 3)
    n_three = np.bincount(doc[at], minlength=n_docs).astype(np.float64) if len(at) else np.zeros(n_docs)
    feed = data == 10
    line_end = np.flatnonzero(feed)
    line_start = np.sort(np.concatenate([offsets[:-1], line_end + 1]))
    line_first, line_last = np.searchsorted(starts, line_start), np.searchsorted(starts, np.append(line_start[1:], len(data)))
    with_words = line_last > line_first
    line_first, line_last = line_first[with_words], line_last[with_words]
    line_doc = doc[line_first] if len(line_first) else np.zeros(0, np.int64)
    lines = ranges(hashes, line_first, line_last, 0xD1342543DE82EF95) if len(line_first) else np.zeros(0, np.uint64)
    n_lines = np.bincount(line_doc, minlength=n_docs).astype(np.float64)
    found = {
        "log_words": np.log1p(n_words), "word_bytes": share(total(length), n_words), "long_words": share(total(length > 12), n_words),
        "short_words": share(total(length < 3), n_words), "distinct_words": share(distinct(doc, hashes), n_words), "repeated_next": share(total(same), n_words),
        "repeated_windows": share(n_three - distinct(doc[at], three), n_three), "repeated_lines": share(n_lines - distinct(line_doc, lines), n_lines),
        "log_lines": np.log1p(n_lines), "line_words": share(n_words, n_lines),
    }
    found |= {k: share(of_bytes(m[data]), n_bytes) for k, m in _CLASSES.items()}
    return np.column_stack([found[f] for f in FEATURES]) if n_docs else np.zeros((0, len(FEATURES)))


class Trees:
    """Complete binary trees in arrays: node i of a tree has the children 2i + 1 and 2i + 2."""

    def __init__(self, start: float, feature: np.ndarray, edge: np.ndarray, leaf: np.ndarray):
        self.start, self.feature, self.edge, self.leaf = start, feature, edge, leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if not len(self.feature):
            return out
        tree, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.edge[tree, node])
        return out + self.leaf[tree, node - (2**DEPTH - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log odds of ``y``. Without rows of both labels: the prior alone."""
    prior = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(prior / (1 - prior)))
    inner = 2**DEPTH - 1
    none = np.zeros((0, inner), np.int64)
    if len(y) < 2 or y.min() == y.max():
        return Trees(start, none, none.astype(float), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    n_features, features, cuts, leaves = x.shape[1], [], [], []
    z = np.full(len(y), start)
    for _ in range(TREES):
        p = sigmoid(z)
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut, limit = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        for depth in range(DEPTH):
            low, n = 2**depth - 1, 2**depth
            best, own = np.full(n, 1e-6), node - low
            for f in range(n_features):
                place = own * BINS + binned[:, f]
                sums = np.stack([np.bincount(place, weights=w, minlength=n * BINS).reshape(n, BINS) for w in (g, h)])
                left = np.cumsum(sums, axis=2)[:, :, :-1]
                whole = sums.sum(axis=2)[:, :, None]
                right = whole - left
                gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - whole[0] ** 2 / (whole[1] + RIDGE)
                gain[(left[1] < 1) | (right[1] < 1)] = 0
                gain = gain[:, : len(edges[f])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(axis=1)
                better = gain[np.arange(n), at] > best
                for i in np.flatnonzero(better):
                    best[i], feature[low + i], cut[low + i], limit[low + i] = gain[i, at[i]], f, edges[f][at[i]], at[i]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > limit[node])
        leaf = node - inner
        top, low_ = (np.bincount(leaf, weights=w, minlength=inner + 1) for w in (g, h))
        value = -RATE * top / (low_ + RIDGE)
        z += value[leaf]
        features.append(feature), cuts.append(cut), leaves.append(value)
    return Trees(start, np.array(features), np.array(cuts), np.array(leaves))


def learn(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees from a bounded sample of labelled rows; only its statistics come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                x = statistics(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float64())), batch.column("label")], names=["doc_id", "x", "label"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_texts(docs, sample(labels, "quality")).mapInArrow(run, f"doc_id {kind}, x array<double>, label int").orderBy("doc_id", "x").collect()
    return grow(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([float(r["label"] > 0) for r in rows]))


def scores(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; a null text is empty, and an empty one has a score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                found = trees.score(statistics(batch.column("text")))
                held = [held_out(i) for i in batch.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(held), pa.array(found), pa.array((found >= 0.3).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """A score for every document. Null and empty texts have one; rows that repeat, ids or texts, have equal scores each; null ids are
    not held out; ties in the sample go to the lesser hash and then id; very long texts are whole. Extra columns are not read. No rows for no documents.
    """
    docs = table(spark, folder, "documents")
    return scores(docs, learn(docs, table(spark, folder, "labels")))
