"""Edges, sides and covers of printed tables: an order is a page, its items draw strokes and cells. All orders and items are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import intervals, lattice
from tessera.plans.dialect import Book
from tessera.sources.tables import table

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS

ITEM = """item AS (SELECT o_custkey AS doc, l_orderkey AS page, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS INT) AS qty, CAST(round(l_discount * 100) AS INT) AS disc, l_returnflag AS flag
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _items(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"))
    item = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("int").alias("qty"),
        F.round(F.col("l_discount") * 100).cast("int").alias("disc"), F.col("l_returnflag").alias("flag"),
    )
    return item.join(orders, "page")


SIDES = f"""WITH {ITEM},
side AS (SELECT DISTINCT doc, page, n FROM item),
near AS (SELECT s.doc, s.page, s.n, greatest(i.disc * 10, 0) AS a, least(i.disc * 10 + i.qty * 9, 450) AS b FROM side s JOIN item i ON i.page = s.page AND abs(i.n * 2 - s.n * 2) <= 3 WHERE i.disc * 10 < 450 AND i.qty > 0),
swept AS (SELECT *, max(b) OVER (PARTITION BY page, n ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM near),
both_ AS (SELECT doc, page, n, max(b - a) / 450 AS best, sum(greatest(0, b - greatest(a, coalesce(reach, a)))) / 450 AS share FROM swept GROUP BY ALL)
SELECT doc, page, n::VARCHAR AS id, round(coalesce(best, 0), 6) AS best, coalesce(best, 0) >= 0.45 AS covers, round(coalesce(share, 0), 6) AS share FROM side LEFT JOIN both_ USING (doc, page, n)"""


@book.frame("SUB66 TBL16", SIDES)
def side_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each row's side the strokes near it cover: the best one, and their union."""
    item = _items(spark, folder)
    at = (F.col("n") * 2).cast("double").alias("position")
    edges = item.select("doc", "page", at, (F.col("disc") * 10).cast("double").alias("start"), (F.col("disc") * 10 + F.col("qty") * 9).cast("double").alias("end"))
    targets = item.select("doc", "page", F.col("n").cast("string").alias("id"), at, F.lit(0.0).alias("low"), F.lit(450.0).alias("high")).distinct()
    return lattice.sides(targets, edges).select("doc", "page", "id", F.round("best", 6).alias("best"), "covers", F.round("share", 6).alias("share"))


_KEEP = "list_reduce([[]::DOUBLE[]] || list_transform({}, lambda x: [x]), lambda s, x: CASE WHEN len(s) = 0 OR x[1] - s[-1] > 2.5 THEN s || x ELSE s END)"
LATTICE = f"""WITH {ITEM},
span AS (SELECT doc, page, min(n * 12) - 4 AS y_lo, max(n * 12 + 10) + 4 AS y_hi, min(disc * 10) - 4 AS x_lo, max(disc * 10 + 80) + 4 AS x_hi FROM item GROUP BY ALL),
edge AS (SELECT doc, page, flag <> 'R' AS level, CASE WHEN flag <> 'R' THEN disc * 10 ELSE n * 12 END AS lo, CASE WHEN flag <> 'R' THEN disc * 10 + qty * 3 ELSE n * 12 + qty END AS hi FROM item),
fit AS (SELECT *, CASE WHEN level THEN y_lo ELSE x_lo END AS s_lo, CASE WHEN level THEN y_hi ELSE x_hi END AS s_hi FROM edge JOIN span USING (doc, page)),
good AS (SELECT DISTINCT doc, page, level, (lo + hi) / 2 AS mid FROM fit WHERE least(hi, s_hi) > greatest(lo, s_lo) AND (least(hi, s_hi) - greatest(lo, s_lo)) / greatest(hi - lo, 1) >= 0.45 AND (lo + hi) / 2 BETWEEN s_lo - 20 AND s_hi + 20),
kept AS (SELECT doc, page, level, {_KEEP.format('list(mid ORDER BY mid)')} AS at FROM good GROUP BY ALL)
SELECT doc, page, array_to_string(list_transform(list_sort(list_distinct(coalesce(h.at, []) || [y_lo, y_hi]::DOUBLE[])), lambda x: round(x, 2)::DECIMAL(12, 2)::VARCHAR), ' ') AS h_bounds,
       array_to_string(list_transform(list_sort(list_distinct(coalesce(v.at, []) || [x_lo, x_hi]::DOUBLE[])), lambda x: round(x, 2)::DECIMAL(12, 2)::VARCHAR), ' ') AS v_bounds
FROM span LEFT JOIN (SELECT * FROM kept WHERE level) h USING (doc, page) LEFT JOIN (SELECT * FROM kept WHERE NOT level) v USING (doc, page)"""


@book.frame("TBL17 SUB68 SUB69", LATTICE)
def order_lattice(spark: SparkSession, folder: str) -> DataFrame:
    """The bounds of rows and columns of each order's page, from the strokes and cells of its items."""
    item = _items(spark, folder)
    level = F.col("flag") != "R"
    x, y = F.col("disc") * 10, F.col("n") * 12
    objects = item.select(
        "doc", "page", F.when(level, "h").otherwise("v").alias("orientation"), x.cast("double").alias("x0"), F.when(level, x + F.col("qty") * 3).otherwise(x).cast("double").alias("x1"),
        y.cast("double").alias("top"), F.when(level, y).otherwise(y + F.col("qty")).cast("double").alias("bottom"), F.lit("line").alias("source"),
    )
    atoms = item.select("doc", "page", x.alias("x0"), y.alias("y0"), (x + 80).alias("x1"), (y + 10).alias("y1"))
    spelled = lambda c: F.array_join(F.transform(c, lambda v: F.round(v, 2).cast("decimal(12,2)").cast("string")), " ").alias(c)
    return lattice.lattice(atoms, lattice.structural_edges(objects)).select("doc", "page", spelled("h_bounds"), spelled("v_bounds"))


PROOFS = f"""WITH {ITEM},
rect AS (SELECT page, n AS r0, n + 1 + supp % 2 AS r1, part % 3 AS c0, part % 3 + 1 + qty % 3 AS c1 FROM item),
whole AS (SELECT page, min(n) AS r0, max(n) + 1 AS r1 FROM item GROUP BY page),
row_ AS (SELECT page, c0, c1, unnest(range(r0, r1)) AS r FROM rect),
cell AS (SELECT page, r, c, count(*) AS k FROM (SELECT page, r, unnest(range(c0, c1)) AS c FROM row_) GROUP BY ALL),
sized AS (SELECT w.page, (w.r1 - w.r0) * 4 - count(*) FILTER (r >= w.r0 AND r < w.r1 AND c < 4) AS gap, coalesce(sum(k - 1), 0) AS overlap, count(*) FILTER (NOT (r >= w.r0 AND r < w.r1 AND c < 4)) AS outside FROM whole w LEFT JOIN cell USING (page) GROUP BY w.page, w.r0, w.r1)
SELECT page, gap::BIGINT AS gap, overlap::BIGINT AS overlap, outside::BIGINT AS outside, array_to_string(list_filter([CASE WHEN gap > 0 THEN 'GAP' END, CASE WHEN overlap > 0 THEN 'OVERLAP' END, CASE WHEN outside > 0 THEN 'OUTSIDE' END], lambda x: x IS NOT NULL), ',') AS reasons FROM sized"""


@book.frame("TBL19 SUB71", PROOFS)
def cover_proofs(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the merged cells of each order's table tile it: what is left open, covered twice, or outside."""
    item = _items(spark, folder)
    first = F.col("part") % 3
    rects = item.select("page", F.col("n").alias("r0"), (F.col("n") + 1 + F.col("supp") % 2).cast("int").alias("r1"), first.cast("int").alias("c0"), (first + 1 + F.col("qty") % 3).cast("int").alias("c1"))
    whole = item.groupBy("page").agg(F.min("n").alias("r0"), (F.max("n") + 1).alias("r1")).withColumns({"c0": F.lit(0), "c1": F.lit(4)})
    found = intervals.covers(rects, whole, "page")
    return found.select("page", *(F.col(c).cast("long").alias(c) for c in ("gap", "overlap", "outside")), F.array_join("reasons", ",").alias("reasons"))
