"""Validation of a refusal threshold over the labelled documents, by random halves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import resampling
from tessera.plans.dialect import Book, Duck, Spark
from tessera.plans.metrics import runs

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS


def _records(d) -> str:
    return f"WITH {runs(d)} SELECT doc_id AS key, score * {d.d('25')} AS ratio, n_words >= 20 AS gated, coalesce(expected, false) AS expected, coalesce(decided, false) AS decided, n_words < 120 AS partial FROM r"


SPLIT = f"""
WITH r AS ({_records(Duck())}),
kinds AS (SELECT *, coalesce(gated, false) AS g, coalesce(partial, false) AS p FROM r),
trial AS (SELECT unnest(range({resampling.TRIALS})) AS trial), tau AS (SELECT unnest([{', '.join(f'{t / 100}::DOUBLE' for t in resampling.GRID)}]) AS tau UNION ALL SELECT NULL),
at AS (SELECT key, tau, expected, p, decided AND NOT (tau IS NOT NULL AND g AND coalesce(ratio > tau, false)) AS decided, trial, (strpos('0123456789abcdef', substr(md5(key || ':' || (trial // 128)), (trial % 128) // 4 + 1, 1)) - 1) >> (3 - trial % 4)::INT & 1 AS cal FROM kinds, trial, tau),
judged AS (SELECT trial, tau, cal, CASE WHEN decided AND NOT expected THEN 10 WHEN NOT decided AND expected THEN 1 WHEN decided AND p THEN 1 ELSE 0 END AS cost FROM at),
sums AS (SELECT trial, tau, count(*) FILTER (cal = 1) AS n_cal, count(*) FILTER (cal = 0) AS n_test, count(*) FILTER (cal = 1 AND cost = 0) AS good, coalesce(sum(cost) FILTER (cal = 1), 0) AS bad, count(*) FILTER (cal = 0 AND cost = 0) AS correct, coalesce(sum(cost) FILTER (cal = 0), 0) AS risk FROM judged GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY good DESC, bad, tau) AS k FROM sums WHERE tau IS NOT NULL)
SELECT trial::INT AS trial, b.tau, b.n_cal, b.n_test, b.correct, b.risk::BIGINT AS risk, z.correct AS base_correct, z.risk::BIGINT AS base_risk FROM best b JOIN sums z USING (trial) WHERE k = 1 AND z.tau IS NULL""".replace("at AS (SELECT key", "turned AS (SELECT key").replace("FROM at)", "FROM turned)")


@book.frame("EXP43", SPLIT)
def split_half(spark: SparkSession, folder: str) -> DataFrame:
    """For each of 300 random halves the refusal threshold that is best on it, and what it does on the other half."""
    return resampling.split_half(spark.sql(_records(Spark(spark, folder))))
