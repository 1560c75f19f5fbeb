"""An inverted-file index of vectors: a table of lists around centroids, and a search that reads few of them.

The centroids are fitted on a bounded sample; every vector is indexed. A row of the table
names its list and, where a list holds more than a block, the part of the list. A query
meets the parts of its nearest ``probes`` lists, block against block, so that a hot list is
divided among tasks like any other. Distances are computed from whole vectors, so what
is found has its exact distance.

``exact=True`` goes on where the first answer leaves room: by the triangle inequality a list whose
centroid is farther than its radius plus the k-th distance cannot hold a nearer vector; all
others that were not probed are read in a second step. Then the result is that of
``dense.nearest``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.dense import QUERIES, SLAB, VECTORS, _cut, _matrix, _ranked
from tessera.session import settled

#: Sampled vectors for each list, most lists, rounds of k-means, and queries or vectors compared with all centroids at a time.
SAMPLE, LISTS, ROUNDS, ASSIGNED = 64, 16_384, 8, 1024
#: Vectors and queries of the sample that shows how many lists must be probed, and the recall that is aimed at.
SHOWN, ASKED, TARGET = 20_000, 512, 0.97
#: Vectors that a scope holds at most to be asked by id instead of by the index.
NARROW = 100


class Index(NamedTuple):
    """``table`` has (list, part, vec_id, embedding, scope); ``parts`` and ``radius`` are by list.

    ``ranks`` says for the near neighbours in a sample the how-manieth list of their query they lie in, in order.
    """

    table: DataFrame
    centroids: np.ndarray
    parts: np.ndarray
    radius: np.ndarray
    ranks: np.ndarray

    def probes(self, target: float = TARGET) -> int:
        """Lists to probe so that ``target`` of the sample's neighbours lie in them."""
        return int(self.ranks[min(len(self.ranks) - 1, int(target * len(self.ranks)))]) + 1 if len(self.ranks) else max(1, len(self.centroids))


def usable(vectors: DataFrame, *more: str) -> DataFrame:
    """Rows whose embedding is there and holds no null and no value that is not finite, as doubles."""
    as_doubles = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(good).select(*more, as_doubles.alias("embedding"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0.0)


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    for batch in batches:
        for s in range(0, batch.num_rows, ASSIGNED):
            part = pa.Table.from_batches([batch.slice(s, ASSIGNED)])
            yield part, _matrix(part)


def build(vectors: DataFrame, lists: int | None = None, scope: str | None = None, seed: int = 7) -> Index:
    """Index ``vectors`` (vec_id, embedding and, if named, the column ``scope``), all of one length.

    The number of lists is by default the square root of the number of vectors, up to
    LISTS. Centroids come from k-means over at most SAMPLE vectors for each list, those
    of the least hash of their id; SHOWN of these show how
    many lists hold the neighbours. An empty table has an index without lists.
    """
    rows = usable(vectors, F.col("vec_id").cast("long").alias("vec_id"), (F.col(scope) if scope else F.lit(None)).cast("string").alias("scope"))
    n = rows.count()
    if not n:
        table = rows.select(F.lit(0).alias("list"), F.lit(0).alias("part"), "vec_id", "embedding", "scope")
        return Index(table, np.zeros((0, 0)), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))
    lists = max(1, min(lists or round(n**0.5), LISTS, n))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * lists)
    model = KMeans(k=lists, seed=seed, maxIter=ROUNDS, featuresCol="v").fit(sample.select(array_to_vector("embedding").alias("v")))
    centroids = np.stack(model.clusterCenters())
    shown = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SHOWN).select("embedding")
    ranks = _ranks(np.array([r["embedding"] for r in shown.toLocalIterator()]), centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y in _slabs(batches):
            d = _distances(y, centroids)
            near = d.argmin(axis=1)
            far = np.sqrt(d[np.arange(len(near)), near])
            yield from part.append_column("list", pa.array(near, pa.int32())).append_column("far", pa.array(far)).to_batches()

    placed = settled(rows.mapInArrow(assign, "vec_id long, scope string, embedding array<double>, list int, far double"))
    held = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row for each list
    parts, radius = np.zeros(len(centroids), dtype=np.int64), np.zeros(len(centroids))
    for r in held:
        parts[r["list"]], radius[r["list"]] = -(-r["n"] // VECTORS), r["far"]
    by_list = F.broadcast(_small(placed, parts))  # LISTS rows at most
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    return Index(placed.join(by_list, "list").select("list", part.alias("part"), "vec_id", "embedding", "scope"), centroids, parts, radius, ranks)


def _ranks(sample: np.ndarray, centroids: np.ndarray, k: int = 10) -> np.ndarray:
    """Of the ``k`` nearest neighbours of up to ASKED vectors within the sample: the rank of their list for the query, sorted."""
    asked, own = sample[:ASKED], _distances(sample, centroids).argmin(axis=1)
    near = _distances(asked, sample)
    near[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    at = np.argsort(near, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    rank = np.argsort(np.argsort(_distances(asked, centroids), axis=1, kind="stable"), axis=1)
    return np.sort(np.take_along_axis(rank, own[at], axis=1).ravel())


def _small(df: DataFrame, parts: np.ndarray) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(parts) if p], "list int, parts long")


def _probed(queries: DataFrame, index: Index, probes: int, second: bool) -> DataFrame:
    """Each query once for each list that it asks: its nearest ones, or (``second``) those left that may hold something nearer than ``within``."""
    centroids, radius, full = index.centroids, index.radius, index.parts > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y in _slabs(batches):
            d = np.where(full, _distances(y, centroids), np.inf)
            order = np.argsort(d, axis=1, kind="stable")
            asked = np.zeros(d.shape, dtype=bool)
            np.put_along_axis(asked, order[:, :probes], True, axis=1)
            if second:
                within = part.column("within").to_numpy()
                asked = ~asked & ((np.sqrt(d) - radius) ** 2 * (np.sqrt(d) > radius) <= within[:, None] + 1e-5)
            at, list_ = np.nonzero(asked & full)
            yield from part.take(pa.array(at)).append_column("list", pa.array(list_, pa.int32())).to_batches()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{fields}, list int")


def _meet(asked: DataFrame, index: Index, k: int, by_scope: bool) -> DataFrame:
    """The best ``k`` of each query in each part of the lists that it asks; both sides of a pair of blocks are bounded."""
    per_list = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("slots"))
    parts = F.broadcast(_small(asked, index.parts))
    slot = F.pmod(F.xxhash64("query_id"), F.col("slots")).cast("int")
    left = asked.join(per_list, "list").join(parts, "list").withColumn("slot", slot).withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    left = left.select("list", "part", "slot", "query_id", "embedding", "scope")
    right = index.table.join(per_list, "list").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")

    def best(ask: pa.Table, held: pa.Table) -> pa.Table:
        out = ([], [], [])
        if ask.num_rows and held.num_rows:
            a, b = _matrix(ask), _matrix(held)
            own, ids = ask.column("query_id").to_numpy(), held.column("vec_id").to_numpy()
            scope, scopes = np.array(ask.column("scope").to_pylist(), dtype=object), np.array(held.column("scope").to_pylist(), dtype=object)
            for s in range(0, len(a), SLAB):
                score = np.round(_distances(a[s : s + SLAB], b), 6)
                score[own[s : s + SLAB, None] == ids] = np.inf
                if by_scope:
                    score[(scope[s : s + SLAB, None] != scopes) | (scopes == None)] = np.inf  # noqa: E711
                for i, row in enumerate(score):
                    at = _cut(row, ids, k)
                    out[0].append(np.full(len(at), own[s + i]))
                    out[1].append(ids[at])
                    out[2].append(row[at])
        columns = [np.concatenate(c) if c else [] for c in out]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    keys = ["list", "part", "slot"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(best, "query_id bigint, vec_id bigint, score double")


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, scope: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` vectors of least squared distance among those that the probed lists hold.

    ``probes`` is by default what the index says of its sample. With ``scope`` (a column of ``queries``, indexed by ``build``)
    only vectors of the query's own scope count (a null scope has none). Scores are rounded to six places, ties go to
    the least id, a query does not find its own id. Unusable query vectors give no rows.
    """
    asked = usable(queries, F.col("query_id").cast("long").alias("query_id"), (F.col(scope) if scope else F.lit(None)).cast("string").alias("scope"))
    if not len(index.centroids):
        return asked.select("query_id", F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    probes = probes or index.probes()
    found = _ranked(_meet(settled(_probed(asked, index, probes, False)), index, k, bool(scope)), k, ascending=True)
    if not exact:
        return found
    found = settled(found)
    kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("within"))
    again = asked.join(kth, "query_id", "left").withColumn("within", F.coalesce("within", F.lit(float("inf"))))
    more = _meet(settled(_probed(again, index, probes, True)), index, k, bool(scope))
    return _ranked(found.select("query_id", "vec_id", "score").union(more), k, ascending=True)


def scoped(index: Index, vectors: DataFrame, queries: DataFrame, k: int, scope: str) -> DataFrame:
    """The ``k`` nearest vectors in each query's scope: scopes of up to NARROW vectors are asked by id, larger ones of the index.

    A narrow scope costs its own vectors alone, whatever the size of the table; a wide one
    is a filter of the lists, exact by their radii.
    """
    size = usable(vectors, F.col(scope).alias("scope")).groupBy("scope").count()
    narrow = F.col("count") <= NARROW
    asked = usable(queries, F.col("query_id").cast("long").alias("query_id"), F.col(scope).alias("scope")).join(size, "scope")
    near = asked.where(narrow).drop("count")
    pairs = near.join(usable(vectors, F.col("vec_id").cast("long").alias("vec_id"), F.col(scope).alias("scope")).withColumnRenamed("embedding", "other"), "scope").where("query_id <> vec_id")
    square = F.aggregate(F.zip_with("embedding", "other", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    by_id = _ranked(pairs.select("query_id", "vec_id", F.round(square, 6).alias("score")), k, ascending=True)
    wide = asked.where(~narrow).select("query_id", F.col("scope").alias(scope), "embedding")
    return by_id.unionByName(search(index, wide, k, exact=True, scope=scope))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the exact neighbours, those of them that were found, and their share."""
    keys = ["query_id", "vec_id"]
    hits = exact.select(keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return hits.agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))
