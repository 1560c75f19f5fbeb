"""Lattices of drawn edges: which positions bound rows and columns, and which edges cover a side.

Positions keep a rule that looks odd and is meant: an edge's position is the middle of its
own extent, and of positions close to each other the first stands as long as they are
within the tolerance of it, however long their chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Share of an edge within the span, tolerance of positions, margin of the content, reach of a middle beyond the span, distance of an edge from a side.
COVERAGE, TOLERANCE, MARGIN, REACH, NEAR = 0.45, 2.5, 4, 20, 3.0


def structural_edges(objects: DataFrame) -> DataFrame:
    """(doc, page, orientation, x0, y0, x1, y1, source_type, confidence, thickness) of drawn ``objects``.

    Objects have doc, page, orientation (h or v), x0, x1, top, bottom and source. A level
    edge lies at the middle of its heights, an upright one at the middle of its widths;
    edges of rectangles are less certain than lines.
    """
    level = F.col("orientation") == "h"
    middle = lambda a, b: F.round((F.col(a) + F.col(b)) / 2, 2)
    rect = F.col("source").isin("rect", "rects")
    return objects.select(
        "doc", "page", F.when(level, "HORIZONTAL").otherwise("VERTICAL").alias("orientation"),
        F.when(level, F.least("x0", "x1")).otherwise(middle("x0", "x1")).alias("x0"), F.when(level, middle("top", "bottom")).otherwise(F.least("top", "bottom")).alias("y0"),
        F.when(level, F.greatest("x0", "x1")).otherwise(middle("x0", "x1")).alias("x1"), F.when(level, middle("top", "bottom")).otherwise(F.greatest("top", "bottom")).alias("y1"),
        F.when(F.coalesce(rect, F.lit(False)), "RECT_EDGE").otherwise("LINE").alias("source_type"), F.when(F.coalesce(rect, F.lit(False)), 0.75).otherwise(0.85).alias("confidence"),
        F.round(F.abs(F.col("bottom") - F.col("top")), 2).alias("thickness"),
    )


def _first_of_each(ordered: Column) -> Column:
    """Of sorted positions those more than TOLERANCE beyond the last one kept."""
    keep = lambda s, p: F.when(F.size(s) == 0, F.array(p)).when(p - F.element_at(s, -1) > TOLERANCE, F.concat(s, F.array(p))).otherwise(s)
    return F.aggregate(ordered, F.expr("CAST(array() AS ARRAY<DOUBLE>)"), keep)


def lattice(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, page, h_bounds, v_bounds): the positions that bound the content of ``atoms`` (doc, page, x0, y0, x1, y1).

    An edge counts if COVERAGE of it lies within the content's span and its middle within
    REACH of it. The content's own limits, MARGIN outside, are always bounds. Pages without atoms have none.
    """
    span = atoms.groupBy("doc", "page").agg((F.min("y0") - MARGIN).alias("y_lo"), (F.max("y1") + MARGIN).alias("y_hi"), (F.min("x0") - MARGIN).alias("x_lo"), (F.max("x1") + MARGIN).alias("x_hi"))
    level = F.col("orientation") == "HORIZONTAL"
    e = edges.join(span, ["doc", "page"]).withColumns({
        "lo": F.when(level, F.least("x0", "x1")).otherwise(F.least("y0", "y1")), "hi": F.when(level, F.greatest("x0", "x1")).otherwise(F.greatest("y0", "y1")),
        "s_lo": F.when(level, F.col("y_lo")).otherwise(F.col("x_lo")), "s_hi": F.when(level, F.col("y_hi")).otherwise(F.col("x_hi")),
    })
    overlap, middle = F.least("hi", "s_hi") - F.greatest("lo", "s_lo"), (F.col("lo") + F.col("hi")) / 2
    good = (overlap > 0) & (overlap / F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0)) >= COVERAGE) & middle.between(F.col("s_lo") - REACH, F.col("s_hi") + REACH)
    found = e.where(good).select("doc", "page", "orientation", middle.cast("double").alias("at")).distinct()  # equal positions add nothing
    kept = found.groupBy("doc", "page").pivot("orientation", ["HORIZONTAL", "VERTICAL"]).agg(_first_of_each(F.array_sort(F.collect_list("at"))))
    none = F.expr("CAST(array() AS ARRAY<DOUBLE>)")
    bounds = lambda c, a, b: F.array_sort(F.array_distinct(F.concat(F.coalesce(c, none), F.array(F.col(a).cast("double"), F.col(b).cast("double")))))
    return span.join(kept, ["doc", "page"], "left").select("doc", "page", bounds("HORIZONTAL", "y_lo", "y_hi").alias("h_bounds"), bounds("VERTICAL", "x_lo", "x_hi").alias("v_bounds"))


def sides(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """``targets`` (doc, page, id, position, low, high) with best (the largest share of one near edge), covered (by that edge) and share (of all near edges together).

    ``edges`` has doc, page, position, start, end. Near is within NEAR. The share of the
    union sees gaps and overlaps that the sum of lengths does not: it is a window over the edges near one
    side, which are a part of one page's, and nothing is written.
    """
    keys = ["doc", "page"]
    t = targets.where("high > low")
    near = t.join(edges.select(*keys, F.col("position").alias("of"), "start", "end"), keys).where(F.abs(F.col("of") - F.col("position")) <= NEAR)
    near = near.where((F.least("end", "high") > F.greatest("start", "low")))
    a, b, length = F.greatest("start", "low"), F.least("end", "high"), F.col("high") - F.col("low")
    whole = F.col("start") < F.col("end")  # others do not count in the union
    reach = F.max(F.when(F.col("whole"), F.col("b"))).over(W.partitionBy(*keys, "id").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1))
    swept = near.select(*keys, "id", "low", "high", whole.alias("whole"), a.alias("a"), b.alias("b")).withColumn("reach", reach)
    new = F.when(F.col("whole"), F.greatest(F.lit(0.0), F.col("b") - F.greatest("a", F.coalesce("reach", "a"))))
    one = swept.groupBy(*keys, "id").agg(F.max((F.col("b") - F.col("a")) / length).alias("best"), F.coalesce(F.sum(new / length), F.lit(0.0)).alias("share"))
    out = targets.join(one, [*keys, "id"], "left")
    best = F.coalesce("best", F.lit(0.0))
    return out.select(*(targets[c] for c in targets.columns), best.alias("best"), (best >= COVERAGE).alias("covers"), F.coalesce("share", F.lit(0.0)).alias("share"))
