"""Unions of intervals and how much of a target they cover, by a sweep and without pairs.

The union comes from the running maximum of the ends: an interval that starts beyond all
ends before it begins a new island. The length that islands cover up to a point is
a running sum, so a target's coverage is a difference of two such sums: points and
islands are ordered together once, and no target meets an island. Both sweeps are
``scan.running``, so a key that holds most intervals is divided among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.scan import blocked, running


def union(spans: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """(keys, start, end): the islands of ``spans`` (keys, start, end); touching intervals are one. Empty, reversed and null intervals do not count."""
    good = spans.where("start < end").select(*keys, "start", "end").withColumn("id", F.monotonically_increasing_id())
    order = ["start", "id"]
    reach = running(blocked(good, keys, order, blocks), keys, order, most={"reach": F.col("end")}, before=True)
    new = (F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("long")
    return running(reach, keys, order, total={"island": new}).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def covered(targets: DataFrame, islands: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """``targets`` (keys, id, low, high; ids are unique within a key) with ``covered``: the length of [low, high] that ``islands`` (disjoint) cover.

    A target that is empty or reversed has 0, as has one whose key has no islands.
    """
    point = lambda c, sign: targets.select(*keys, F.col("id").cast("string").alias("id"), F.lit(sign).alias("sign"), F.col(c).cast("double").alias("at"), F.lit(None).cast("double").alias("to"))
    of_islands = islands.select(*keys, F.lit("").alias("id"), F.lit(0).alias("sign"), F.col("start").cast("double").alias("at"), F.col("end").cast("double").alias("to"))
    events = point("low", -1).union(point("high", 1)).union(of_islands)
    order = ["at", "sign", "id"]
    swept = running(blocked(events, keys, order, blocks), keys, order, total={"length": F.when(F.col("sign") == 0, F.col("to") - F.col("at"))}, last={"until": F.col("to")})
    upto = F.col("length") - F.greatest(F.lit(0.0), F.coalesce(F.col("until") - F.col("at"), F.lit(0.0)))
    sums = swept.where("sign <> 0").groupBy(*keys, "id").agg(F.sum(F.col("sign") * upto).alias("covered"))
    renamed = sums.select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("id").alias("of_id"), "covered")
    same = F.col("id").cast("string") == F.col("of_id")
    for k in keys:
        same &= targets[k].eqNullSafe(renamed[f"of_{k}"])
    joined = targets.join(renamed, same, "left")
    return joined.select(*(targets[c] for c in targets.columns), F.when(F.col("high") > F.col("low"), F.coalesce("covered", F.lit(0.0))).otherwise(0.0).alias("covered"))


def coverage(targets: DataFrame, spans: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """``targets`` with covered and share, of spans that may overlap."""
    out = covered(targets, union(spans, keys, blocks), keys, blocks)
    return out.withColumn("share", F.when(F.col("high") > F.col("low"), F.col("covered") / (F.col("high") - F.col("low"))).otherwise(0.0))


def covers(rects: DataFrame, whole: DataFrame, key: str, blocks: int | None = None) -> DataFrame:
    """Whether the rectangles of a key cover its ``whole`` exactly: key, gap, overlap, outside (areas in cells) and reasons.

    ``rects`` has key, r0, r1, c0, c1 and ``whole`` one row for each key with the same
    columns; rows and columns are whole numbers, ends are not included. A rectangle is cut
    into its rows; in each row the sweep gives the union's length, so the work grows with
    heights and never with pairs of rectangles. Overlap counts what lies beyond a first
    rectangle, inside or outside.
    """
    rows = rects.where("r0 < r1 AND c0 < c1").select(key, F.explode(F.sequence("r0", F.col("r1") - 1)).alias("row"), F.col("c0").alias("start"), F.col("c1").alias("end"))
    keys = [key, "row"]
    islands = union(rows, keys, blocks)
    frame = whole.select(key, "r0", "r1", "c0", "c1")
    spans = islands.join(frame, key, "left")
    length = F.col("end") - F.col("start")
    inside = F.when((F.col("row") >= F.col("r0")) & (F.col("row") < F.col("r1")), F.greatest(F.lit(0), F.least("end", "c1") - F.greatest("start", "c0"))).otherwise(0)
    per_key = spans.groupBy(key).agg(F.sum(length).alias("union"), F.sum(inside).alias("inside"))
    areas = rows.groupBy(key).agg(F.sum(length).alias("area"))
    area = (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0"))
    at = frame.join(per_key, key, "left").join(areas, key, "left").na.fill(0, ["union", "inside", "area"])
    sizes = at.select(key, (area - F.col("inside")).alias("gap"), (F.col("area") - F.col("union")).alias("overlap"), (F.col("union") - F.col("inside")).alias("outside"))
    reasons = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(c.upper())) for c in ("gap", "overlap", "outside"))))
    return sizes.withColumn("reasons", reasons)
