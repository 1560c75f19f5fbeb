"""From raw documents to token digests of a training mix, in five stages.

Each stage reads all that its predecessor kept, from a Parquet table in the shared
folder, and its decisions take effect: rejected documents go, one document of each
near-duplicate class stays, secrets are replaced in the text, documents are repeated or
left out as the mix says, and what remains is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import near_dup, pieces, quality_rules, secret_scan, source_mix
from tessera.llm.shared import settle, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep: null and empty texts go, rows that repeat share a verdict, one on a threshold stays. Texts are whole, of any length; extra columns stay as they are; an empty table stays empty."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least id: of null and empty texts one, of rows equal in id and text one. Texts are whole, of any length; extra columns stay as they are; an empty table stays empty."""
    return near_dup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in the text replaced by its kind; null texts stay null, rows that repeat stay. Texts are whole, of any length; extra columns stay as they are; an empty table stays empty."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: null and empty texts at the rate of their source, a null source is one of its own, rows that repeat are drawn alike. Texts are whole, of any length; extra columns stay as they are; an empty table stays empty."""
    return source_mix.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix, its number of tokens and the digests of ids and decoded text; repeats have a row each, a null text is empty. An empty table gives no rows."""
    return pieces.digests(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("secret_scans", secrets),
    ("source_mix", mix),
    ("sentencepiece", encode),
]

#: Near-duplicate classes and merge-type encoding are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
