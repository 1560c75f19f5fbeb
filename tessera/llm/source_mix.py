"""Mixing sources to target weights: rates per source, then whole copies plus one seeded draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import documents, settle, table, whole, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, the number of words (null and empty texts: 0), with the key of the draw.

    The key is the id, or the text's digest where the id is null, so that rows without an
    id don't share one draw; rows with equal ids get equal draws.
    """
    return documents(docs, "source").select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), key().alias("draw_key")
    )


def key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))


def rates(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target and rate (copies of each document), a row for each source.

    The sources share ``share`` times all sizes by weight; a target stops at ``cap`` times
    its source's size and the excess goes to the others by weight. That ends where
    target = least(cap * size, level * weight) for one level: with the sources in the
    order of cap * size / weight, the level is that of the first source that stays below
    its cap when all before it are at theirs. An empty table gives no rows; sources
    without words have the rate 0.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row for each source from here on: these windows sort sources, not documents.
    ranked = totals.select(
        "*", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).alias("place")
    )
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    all_ = W.partitionBy()
    by_cap = W.orderBy("reach", "place")
    level = (
        (F.lit(share) * F.col("total") - F.coalesce(F.sum("most").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    )
    found = (
        ranked.withColumn("weight", w)
        .withColumn("most", (F.col("source_size") * cap).cast("double"))
        .withColumn("total", F.sum("source_size").over(all_).cast("double"))
        .withColumn("reach", F.col("most") / F.col("weight"))
        .withColumn("own_level", level)
        .withColumn(
            "level",
            F.first(F.when(F.col("own_level") <= F.col("reach"), F.col("own_level")), ignorenulls=True).over(
                by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            ),
        )
        .withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))
    )
    return found.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def copies(rate: Column, draw_key: Column, seed: str = SEED) -> Column:
    """floor(rate) copies and one more with probability equal to the rest, drawn from a hash."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), draw_key)), 1, 8), 16, 10).cast("double")
    return F.floor(rate) + F.when(drawn < (rate - F.floor(rate)) * 4294967296.0, 1).otherwise(0)


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for each document.

    Sizes are counted once and written; the rates have a row for each source, and
    Catalyst broadcasts them only if the written table is small enough by its size.
    """
    sized = settle(sizes(docs))
    rated = settle(rates(sized))
    joined = sized.join(rated, sized["source"].eqNullSafe(rated["source"]))
    n = copies(F.col("rate"), F.col("draw_key"))
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * n).cast("long").alias("taken"), n.cast("int").alias("copies")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed rows: each row of ``docs``, with all its columns, as often as its draw says.

    Columns may have any names. Null and empty texts have no words; they are drawn at
    their source's rate like any other, and repeated rows get equal draws.
    """
    rated = settle(rates(settle(sizes(docs)))).select(F.col("source").alias("of"), "rate")
    rows = docs.select(whole(docs), F.col("source").alias("source"), key().alias("draw_key"))
    joined = rows.join(rated, F.col("source").eqNullSafe(F.col("of"))).withColumn("n", copies(F.col("rate"), F.col("draw_key")).cast("int")).where("n > 0")
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select("row.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's share in the mix. Null and empty texts have size 0 and take no words; a null source comes last; rows that repeat are documents of their own,
    drawn alike; very long texts count whole. Extra columns are not read. No rows for no documents.
    """
    return plan(table(spark, folder, "documents"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS draw_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM totals),
weighed AS (
  SELECT *, [3, 1, 2][place % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS most,
         (sum(source_size) OVER ())::DOUBLE AS total
  FROM ranked),
levels AS (
  SELECT *, most / weight AS reach,
         (1.5::DOUBLE * total - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM weighed),
leveled AS (
  SELECT *, (SELECT arg_min(own_level, (reach, place)) FROM levels WHERE own_level <= reach) AS level FROM levels),
rated AS (
  SELECT source, source_size, least(most, coalesce(level * weight, most)) AS target,
         CASE WHEN source_size > 0 THEN least(most, coalesce(level * weight, most)) / source_size ELSE 0 END AS rate
  FROM leveled),
drawn AS (
  SELECT doc_id, size, source_size, target,
         (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || draw_key), 1, 8))::BIGINT::DOUBLE < (rate - floor(rate)) * 4294967296.0::DOUBLE
                             THEN 1 ELSE 0 END)::INTEGER AS copies
  FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM drawn
"""
