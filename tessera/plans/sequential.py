"""Queries whose steps depend on one another: text pieces, greedy batches, weighted limits, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.segments import greedy_batches, split_texts, weighted_limit
from tessera.plans.dialect import Book
from tessera.sources.tables import spread, table
from tessera.streaming import limits

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS

PIECES = r"""
WITH RECURSIVE p AS (
  SELECT doc_id, text AS rest, 0::BIGINT AS start, CASE WHEN length(text) > 800 THEN length(regexp_extract(substr(text, 1, 800), '(?s)^(.*)[\n。;； ]', 1)) END AS last,
         regexp_matches(substr(text, 1, 800), '[\n。;； ]') AS has FROM documents
  UNION ALL
  SELECT doc_id, next, start + moved, CASE WHEN length(next) > 800 THEN length(regexp_extract(substr(next, 1, 800), '(?s)^(.*)[\n。;； ]', 1)) END, regexp_matches(substr(next, 1, 800), '[\n。;； ]')
  FROM (SELECT doc_id, start, (CASE WHEN has AND last >= 400 THEN last + 1 ELSE 800 END) - 150 AS moved,
               substr(rest, (CASE WHEN has AND last >= 400 THEN last + 1 ELSE 800 END) - 150 + 1) AS next FROM p WHERE last IS NOT NULL)),
c AS (SELECT doc_id, start, trim(CASE WHEN last IS NULL THEN rest WHEN has AND last >= 400 THEN substr(rest, 1, last + 1) ELSE substr(rest, 1, 800) END, e' \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f') AS t FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS piece, start, length(t) AS n_chars, substr(sha256(t), 1, 16) AS digest FROM c WHERE t <> ''"""


@book.frame("ING14 WIN22 ING1", PIECES)
def text_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in pieces of 800 characters, cut after the last separator of a piece's second half, with an overlap of 150."""
    docs = spread(table(spark, folder, "documents")).select(F.col("doc_id").alias("chunk_id"), "text")
    return split_texts(docs).select(
        F.col("chunk_id").alias("doc_id"), "piece", "start", F.length("text").cast("long").alias("n_chars"), F.substring(F.sha2("text", 256), 1, 16).alias("digest")
    )


BATCHES = """
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations),
g AS (SELECT *, greatest(1, ceil(total / greatest(1, ceil(total / 300)))) AS target FROM t),
b AS (SELECT conv_id, turn, k, n AS used, 0::BIGINT AS batch, target FROM g WHERE k = 1
  UNION ALL SELECT g.conv_id, g.turn, g.k, CASE WHEN b.used > 0 AND b.used + g.n > g.target THEN g.n ELSE b.used + g.n END,
                   b.batch + CASE WHEN b.used > 0 AND b.used + g.n > g.target THEN 1 ELSE 0 END, g.target FROM b JOIN g ON g.conv_id = b.conv_id AND g.k = b.k + 1)
SELECT conv_id, turn, batch FROM b"""


@book.frame("WIN21", BATCHES)
def greedy_turn_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of each conversation packed in order into even batches of about 300 characters."""
    turns = table(spark, folder, "conversations").withColumn("n", F.length("text"))
    return greedy_batches(turns, "conv_id", "turn", "n", 300)


LIMIT = """
WITH RECURSIVE t AS (SELECT user_id, CAST(ts AS DATE) AS day, 1 + event_id % 3 AS amount, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS k FROM events),
s AS (SELECT user_id, day, k, CASE WHEN amount <= 5 THEN amount ELSE 0 END AS used, CASE WHEN amount <= 5 THEN 1 ELSE 0 END AS allowed FROM t WHERE k = 1
  UNION ALL SELECT t.user_id, t.day, t.k, s.used + CASE WHEN s.used + t.amount <= 5 THEN t.amount ELSE 0 END, s.allowed + CASE WHEN s.used + t.amount <= 5 THEN 1 ELSE 0 END
  FROM s JOIN t ON t.user_id = s.user_id AND t.day = s.day AND t.k = s.k + 1)
SELECT user_id, CAST(day AS VARCHAR(10)) AS day, max(k) AS asked, CAST(max(allowed) AS BIGINT) AS allowed, CAST(max(used) AS BIGINT) AS used"""


@book.frame("STR1 STR2", f"{LIMIT}, CAST(greatest(0, 5 - max(used)) AS BIGINT) AS remaining FROM s GROUP BY user_id, day")
def weighted_window_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of one to three units against five a user and day, in order of arrival."""
    calls = table(spark, folder, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_id", (1 + F.col("event_id") % 3).alias("amount"))
    return weighted_limit(calls, ["user_id", "day"], ["event_id"], "amount", 5)


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    # A file source reads folders: where the table is one file, its folder is read and the name picks it out.
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", "events.parquet").parquet(folder)


@book.frame("STR1 STR4 STR16", f"{LIMIT} FROM s GROUP BY user_id, day")
def stream_window_limit(spark: SparkSession, folder: str) -> DataFrame:
    """The same limit as a stream with keyed state."""
    calls = _stream(spark, folder).withColumn("amount", 1 + F.col("event_id") % 3)
    out = limits.run_once(limits.window_limit(calls, 5, late="60 days"), f"limit_{uuid.uuid4().hex}")
    return out.groupBy(F.col("key").alias("user_id"), F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("asked"), F.sum(F.col("allowed").cast("long")).alias("allowed"), F.max("used").alias("used")
    )


@book.frame("STR9 STR14", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def stream_latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user as a stream in complete mode."""
    return limits.run_once(limits.latest_state(_stream(spark, folder)), f"latest_{uuid.uuid4().hex}", "complete")


@book.frame("STR8", "SELECT user_id, event_type, count(DISTINCT json_extract_string(props, '$.k')) AS firsts FROM events GROUP BY ALL")
def stream_first_writes(spark: SparkSession, folder: str) -> DataFrame:
    """How many first writes a stream lets through for each user and type."""
    keyed = _stream(spark, folder).withColumn("k", F.get_json_object("props", "$.k"))
    out = limits.run_once(limits.first_writes(keyed, ["user_id", "event_type", "k"]), f"first_{uuid.uuid4().hex}")
    return out.groupBy("user_id", "event_type").agg(F.count("k").alias("firsts"))
