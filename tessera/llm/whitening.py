"""Whitening of embeddings by a compensated covariance and its principal components.

Two passes over the fit list: the sums of all dimensions give the mean, and then centred
outer products are added up, both in double-double with error-free transformations
(``double_double``). Each task sends one high and one low part; they are merged in two
rounds of groups, so what meets in one place does not grow with the number of tasks beyond its root. The
covariance, one matrix of the vectors' dimension, goes to the driver, where LAPACK's
symmetric eigen-solver (``syevd``: reduction to tridiagonal form, then divide and
conquer) gives the components; these go back to the tasks, which project every row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import double_double as dd
from tessera.llm.shared import bounded, settle, table

#: Components of the query, its scale and offset, and the limit of scaled entries (beyond it they stay at the limit).
COMPONENTS, SCALE, OFFSET, LIMIT = 16, 64, 1_000_000, 1 << 50
#: Groups in the first round of merging.
GROUPS = 64


class Fit(NamedTuple):
    """What is learned: number of vectors, their mean (high, low), its sums as whole numbers if they are, components by row and their eigenvalues, the trace."""

    n: int
    sums: list[int]
    mean: dd.Pair
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch's vectors as rows."""
    return np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, width)


_PART = "slot int, n long, high binary, low binary"


def _added(slot: int, n: int, pair: dd.Pair) -> pa.RecordBatch:
    arrays = [pa.array([slot], pa.int32()), pa.array([n], pa.int64()), *(pa.array([np.ascontiguousarray(x, dtype="<f8").tobytes()], pa.binary()) for x in pair)]
    return pa.RecordBatch.from_arrays(arrays, names=["slot", "n", "high", "low"])


def total(vectors: DataFrame, width: int, shape: tuple[int, ...], of: Callable[[np.ndarray], dd.Pair]) -> tuple[int, dd.Pair]:
    """The number of ``vectors`` (v) and the sum of ``of(batch)`` over all batches, in double-double.

    A task adds up its batches and sends one row; rows are merged by groups of the task's
    number and then all together, in the order of their numbers.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, sum_ = 0, dd.zeros(shape)
        for batch in batches:
            n, sum_ = n + batch.num_rows, dd.add(sum_, of(matrix(batch.column("v"), width)))
        if n:
            yield _added(TaskContext.get().partitionId(), n, sum_)

    def merged(rows: pa.Table) -> pa.Table:
        sum_ = dd.zeros((math.prod(shape),))
        parts = sorted(zip(*(rows.column(c).to_pylist() for c in ("slot", "high", "low"))))
        for _, high, low in parts:
            sum_ = dd.add(sum_, (np.frombuffer(high, "<f8"), np.frombuffer(low, "<f8")))
        return pa.Table.from_batches([_added(parts[0][0], sum(rows.column("n").to_pylist()), sum_)])

    parts = vectors.select("v").mapInArrow(task, _PART)
    groups = parts.groupBy(F.expr(f"slot % {GROUPS}")).applyInArrow(merged, _PART)
    row = groups.groupBy(F.lit(0).alias("all")).applyInArrow(merged, _PART).first()
    if row is None:
        return 0, dd.zeros(shape)
    return row["n"], tuple(np.frombuffer(bytes(row[c]), "<f8").reshape(shape) for c in ("high", "low"))


def centred(y: np.ndarray, mean: dd.Pair) -> dd.Pair:
    """Rows less the mean, in double-double."""
    return dd.add((y, np.zeros_like(y)), (np.broadcast_to(-mean[0], y.shape), np.broadcast_to(-mean[1], y.shape)))


def covariance(vectors: DataFrame, width: int) -> tuple[int, dd.Pair, dd.Pair, dd.Pair]:
    """n, sums, mean and covariance (divisor n, centred before multiplying) of ``vectors`` (v), in double-double."""
    n, sums = total(vectors, width, (width,), dd.column_sums)
    if not n:
        return 0, sums, sums, dd.zeros((width, width))
    mean = dd.divide(sums, n)
    _, products = total(vectors, width, (width, width), lambda y: dd.outer(centred(y, mean)))
    return n, sums, mean, dd.divide(products, n)


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    """Mean and components of ``vectors`` (v): unit eigenvectors by falling eigenvalue, the largest entry of each positive.

    Directions without variance (eigenvalues below the rounding of the largest) are no
    components; of equal vectors, or of none, there are none.
    """
    n, sums, mean, cov = covariance(vectors, width)
    values, columns = np.linalg.eigh(cov[0]) if n else (np.zeros(0), np.zeros((width, 0)))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values, default=0.0) * width * 2.0**-52]
    rows = columns.T[order]
    rows = rows * np.where(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)] < 0, -1.0, 1.0)[:, None] if len(rows) else rows
    return Fit(n, [int(h) + int(l) for h, l in zip(*sums)], mean, rows, values[order], float(np.trace(cov[0])))


def whitened(y: np.ndarray, model: Fit) -> np.ndarray:
    """Rows less the mean, projected on the components, over the roots of their eigenvalues."""
    high, low = centred(y, model.mean)
    return (high + low) @ (model.vectors / np.sqrt(model.values)[:, None]).T


def identity_error(vectors: DataFrame, width: int, model: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened ``vectors``, measured on them, less the identity."""
    k = len(model.values)
    if not k:
        return 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = whitened(matrix(batch.column("v"), width), model)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * k, flat.ravel())], names=["v"])

    projected = vectors.select("v").mapInArrow(project, "v array<double>")
    return float(np.abs(covariance(projected, k)[3][0] - np.eye(k)).max())


def _deviations(y: np.ndarray, model: Fit) -> list[int | None]:
    """The sum over all dimensions of (n * x - sum) ** 2 for whole-numbered rows; None where it exceeds 64 bits."""
    far = model.n * max(float(np.abs(y).max(initial=0.0)), 1.0) + max((abs(s) for s in model.sums), default=0)
    if far < 2**62:
        d = y.astype(np.int64) * model.n - np.array(model.sums, dtype=np.int64)
        if float(np.abs(d).max(initial=0)) ** 2 * max(1, y.shape[1]) < 2**62:
            return (d * d).sum(axis=1).tolist()
    exact = [sum((model.n * int(x) - s) ** 2 for x, s in zip(row, model.sums)) for row in y.tolist()]
    return [v if v < 2**63 else None for v in exact]


def scaled(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, the whole-numbered vector floor(64 c) + 1,000,000, of every row with a usable vector.

    Rows whose vector is null, empty or holds a null or a value that is not finite are
    dropped. So are rows of another length than most rows have (of equally frequent
    lengths the longest holds). |64 c| beyond 2**50 counts as 2**50.
    """
    bounded(embeddings.sparkSession)
    c = F.transform("embedding", lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    kept = embeddings.select("vec_id", c.alias("c")).where("c IS NOT NULL AND size(c) > 0").where(F.forall("c", finite))
    scaled_ = F.transform("c", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("double") + OFFSET)
    return kept.select("vec_id", scaled_.alias("v"))


def usual_length(vectors: DataFrame) -> int:
    """The most frequent length of ``vectors`` (v); 0 if there are none."""
    row = vectors.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return row["length"] if row else 0


ROWS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each row of ``rows`` (vec_id, v) on each component (``ROWS``); the fit list is each distinct v once.

    Repeated rows and repeated or null ids stay. Vectors without any direction of
    variance have no components and give no rows, like an empty table.
    """
    width = usual_length(rows)
    rows = rows.where(F.size("v") == width)
    distinct = settle(rows.select("v").distinct())
    model = fit(distinct, width, components)
    error, k = identity_error(distinct, width, model), len(model.values)
    shares = model.values / model.trace if k else model.values
    kind = rows.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if k else ():
            y = matrix(batch.column("v"), width)
            at = pa.array(np.repeat(np.arange(len(y)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(len(y) * k, model.n)),
                    pa.array(_deviations(y, model), pa.int64()).take(at), pa.array(whitened(y, model).ravel()), pa.array(np.tile(shares, len(y))), pa.array(np.full(len(y) * k, error)),
                ],
                names=["vec_id", *(f.split()[0] for f in ROWS.split(", "))],
            )

    return rows.select("vec_id", "v").mapInArrow(project, f"vec_id {kind}, {ROWS}")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable embedding on up to 16 components; see ``scaled`` and ``whiten`` for nulls, odd lengths, repeats and empty tables.

    Tied eigenvalues share a space in which any basis is right. Extra columns are not read.
    """
    return whiten(scaled(table(spark, folder, "embeddings")))
