"""Versions of the documents through the staged sink and through snapshots, read back from what is active."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import Book
from tessera.session import shared_folder
from tessera.sources.staged import StagedStore
from tessera.sources.tables import table

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS

#: Bytes that an imported snapshot may have.
MOST = 1 << 50


def _store(spark: SparkSession) -> StagedStore:
    return StagedStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def _digests(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@book.frame("SRC4 SRC6 SUB95", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents WHERE lang = 'en'")
def staged_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """The active version after one build of all documents, one that its own check refuses, and one of the English ones."""
    store, docs = _store(spark), table(spark, folder, "documents")
    store.publish(docs, "all")

    def refuse(rows: DataFrame) -> None:
        raise ValueError("refused")

    try:
        store.publish(docs.where("lang <> 'en'"), "refused", refuse)
    except ValueError:
        if store.active() != "all":
            raise
    store.publish(docs.where("lang = 'en'"), "english")
    return _digests(store.read())


@book.frame("SRC14 SUB96", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def snapshot_activation(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a store that has imported another's snapshot, every file checked by size and digest."""
    source, target = _store(spark), _store(spark)
    source.publish(table(spark, folder, "documents"), "v1")
    target.import_snapshot(source.root, "v1", MOST)
    return _digests(target.read())
