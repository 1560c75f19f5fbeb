"""Exact order statistics by group, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets for each doubling of 1 + |value|.
STEPS = 4096


def at_ranks(df: DataFrame, key: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``key``, ``n`` and for each name the value at the rank (from 1) that the function gives for n values.

    Nulls are left out; a rank that no row has gives null; a group without values gives no row;
    rows of a null key are a group.
    Equal values are counted before anything is sorted. Buckets of nearly equal values say
    which one holds a rank, and only that bucket's values are put in order: a group that
    holds most of the rows costs one task a row for each bucket.
    """
    v = F.col(value)
    bucket = F.signum(v) * F.floor(STEPS * F.log2(1 + F.abs(v)))
    counts = df.where(v.isNotNull()).groupBy(key, v.cast("double").alias(value)).agg(F.count("*").alias("c")).withColumn("bucket", bucket)
    of_key = W.partitionBy(key)
    upto = F.sum("c").over(of_key.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    buckets = counts.groupBy(key, "bucket").agg(F.sum("c").alias("c")).select(key, "bucket", "c", (upto - F.col("c")).alias("before"), F.sum("c").over(of_key).alias("n"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items())))
    held = buckets.select(key, "bucket", "c", "before", "n", asked.alias("r")).where("r.rank > before AND r.rank <= before + c")
    # A row for each group and rank.
    held = held.select(F.col(key).alias("of_key"), F.col("bucket").alias("of_bucket"), "r.name", (F.col("r.rank") - F.col("before")).alias("at"))
    inner = F.sum("c").over(W.partitionBy(key, "name").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    same = F.col(key).eqNullSafe(F.col("of_key"))
    found = counts.join(held, same & (F.col("bucket") == F.col("of_bucket"))).withColumn("upto", inner).where(F.col("upto") >= F.col("at")).groupBy(key, "name").agg(F.min(value).alias(value))
    wide = found.groupBy(F.col(key).alias("of_key")).agg(*(F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in ranks))
    return counts.groupBy(key).agg(F.sum("c").alias("n")).join(wide, same, "left").drop("of_key")
