"""Vector queries over the inverted-file index: every 50th vector asks all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ann
from tessera.operators.dense import nearest
from tessera.plans.dialect import Book, Duck
from tessera.sources.tables import table

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS
_SQUARED = Duck().squared("a", "embedding")


def _ten(scope: str) -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, label AS scope, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round({_SQUARED}, 6) AS distance FROM q JOIN embeddings e ON q.query_id <> e.vec_id{scope})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s) WHERE rank <= 10"""


def _both(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, folder, "embeddings")
    return vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")


@book.frame("RET5", _ten(""))
def ivf_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors by the index: few lists first, then those that their radius does not rule out."""
    vectors, asked = _both(spark, folder)
    return ann.search(ann.build(vectors), asked, 10, exact=True).withColumnRenamed("score", "distance")


@book.frame("RET5", f"SELECT count(*) AS n_exact, true AS reached FROM ({_ten('')})")
def ivf_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Exact neighbours, and whether the lists that the index probes by default hold at least nine tenths of them."""
    vectors, asked = _both(spark, folder)
    found = ann.search(ann.build(vectors), asked, 10)
    return ann.recall(found, nearest(vectors, asked, 10, cosine=False)).select("n_exact", (F.col("recall") >= 0.9).alias("reached"))


@book.frame("FLT17 RET5", _ten(" AND e.label = q.scope"))
def ivf_scoped_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of the query's own label: a label of up to 100 vectors is asked by id, others of the index."""
    vectors, asked = _both(spark, folder)
    return ann.scoped(ann.build(vectors, scope="label"), vectors, asked, 10, "label").withColumnRenamed("score", "distance")
