"""Evidence by position: identifiers and their attributes in manual pages, anchors of claims, columns of two models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import positions
from tessera.plans.dialect import Book
from tessera.plans.structure import _FIRST, _Plain, _items, manuals
from tessera.sources.tables import table

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS

#: What questions may ask for, and the words that stand for it.
ALIASES = {"speed": ("speed", "rpm"), "kind": ("economy", "small", "large", "standard", "promo"), "colour": ("red", "blue", "green"), "cause": ("because",)}
_CODE = "concat('F0', CAST(100 + p_partkey % 900 AS VARCHAR(9)))"
_ASK = "CASE (p_partkey {div} 50) % 4 WHEN 0 THEN 'speed' WHEN 1 THEN 'kind' WHEN 2 THEN 'colour' ELSE 'cause' END"


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").where("p_partkey % 50 = 0").selectExpr("p_partkey AS question", f"array({_CODE}) AS identifiers", f"array({_ASK.format(div='DIV')}) AS attributes")


PAGES = f"""
page AS (SELECT o_orderkey AS doc, c_name AS title, concat_ws(chr(10), {_FIRST}, body) AS raw FROM orders JOIN customer ON c_custkey = o_custkey
  LEFT JOIN (SELECT page, string_agg(s, chr(10) ORDER BY n, s) AS body FROM ({_items(_Plain())}) GROUP BY page) b ON b.page = o_orderkey),
flat AS (SELECT doc, title, raw, trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) AS text FROM page),
q AS (SELECT p_partkey AS question, lower({_CODE}) AS code, {_ASK.format(div='//')} AS ask FROM part WHERE p_partkey % 50 = 0)"""
_WORDS = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in ws)}]" for k, ws in ALIASES.items())
TOGETHER = rf"""WITH {PAGES},
hit AS (SELECT question, doc, ask, code, text, CASE ask {_WORDS} END AS words FROM q JOIN flat ON contains(text, code)),
at AS (SELECT *, list_filter(range(1, length(text) + 1), lambda i: starts_with(substr(text, i), code)) AS t,
  list_filter(range(1, length(text) + 1), lambda i: len(list_filter(words, lambda w: starts_with(substr(text, i), w))) > 0) AS w,
  list_filter(range(1, length(text) + 1), lambda i: (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[a-z0-9]')) AND regexp_matches(substr(text, i, 8), '^(?:[0-9]{{1,2}}\.[0-9]{{1,2}}|[a-z][0-9]{{2,5}})(?:[^a-z0-9]|$)')) AS o FROM hit),
far AS (SELECT *, list_filter(o, lambda x: len(list_filter(t, lambda y: abs(y - x) <= 1)) = 0) AS other FROM at)
SELECT question, doc, ask = 'cause' OR len(w) = 0 OR len(list_filter(t, lambda x: len(list_filter(w, lambda y: len(list_filter(other, lambda z: z > least(x, y) AND z < greatest(x, y))) = 0)) > 0)) > 0 AS together FROM far""".replace("at AS (SELECT *", "placed AS (SELECT *").replace("AS o FROM hit)", "AS o FROM hit)").replace("FROM at)", "FROM placed)")


@book.frame("EVD16", TOGETHER)
def identifier_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """For every 50th part's code and each manual page that has it: whether what is asked stands by it, with no other code between."""
    pages = manuals(spark, folder).select(F.col("page").alias("doc"), "text")
    return positions.associated(pages, _questions(spark, folder), ALIASES)


ANCHORED = f"""WITH {PAGES},
scope AS (SELECT doc, trim(regexp_replace(lower(title || ' ' || split_part(raw, chr(10), 1) || ' ' || split_part(raw, chr(10), 2)), '\\s+', ' ', 'g')) AS s FROM flat)
SELECT DISTINCT question, doc AS claim FROM q JOIN scope ON list_contains(regexp_extract_all(s, '[a-z0-9.]+'), code)"""


@book.frame("SUB7", ANCHORED)
def anchored_claims(spark: SparkSession, folder: str) -> DataFrame:
    """The manual pages whose title or first item names the code of every 50th part."""
    lines = F.split("text", "\n")
    claims = manuals(spark, folder).select(F.col("page").alias("claim"), F.concat_ws(" ", "title", F.get(lines, F.lit(0))).alias("subsection"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("text"))
    return positions.anchored(claims, _questions(spark, folder))


SCOPED = """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1000 + l_partkey % 9000 AS a, 1000 + (l_suppkey * 7 + 1) % 9000 AS b, CAST(l_quantity AS INT) AS qty, p_size, l_returnflag AS flag, l_shipdate FROM lineitem JOIN part ON p_partkey = l_partkey),
y AS (SELECT *, CASE flag WHEN 'A' THEN a WHEN 'N' THEN b ELSE 999 END AS m FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, CASE WHEN m <> a AND m <> b THEN true WHEN qty % 5 = 0 THEN false WHEN m = a THEN false ELSE qty <> p_size END AS conflict FROM y"""


@book.frame("SUB47", SCOPED)
def column_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an item's quantity stands in the other model's column of a table of two models, or under neither."""
    item = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("p_partkey") == F.col("l_partkey"))
    x = item.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "concat('el', 1000 + l_partkey % 9000) AS a", "concat('el', 1000 + (l_suppkey * 7 + 1) % 9000) AS b", "CAST(l_quantity AS INT) AS qty", "p_size", "l_returnflag")
    model = F.when(F.col("l_returnflag") == "A", F.col("a")).when(F.col("l_returnflag") == "N", F.col("b")).otherwise("el0999")
    cells = F.when(F.col("qty") % 5 == 0, F.concat(F.col("qty").cast("string"), F.lit(" v"))).otherwise(F.concat(F.col("qty").cast("string"), F.lit(" v "), F.col("p_size").cast("string"), F.lit(" v")))
    window = F.concat(F.lit("technical data "), F.col("a"), F.lit(" "), F.col("b"), F.lit("\nweight 3 g\nrated voltage "), cells)
    conflict = positions.column_conflict(model, F.array(F.lit("voltage")), F.array(F.concat(F.col("qty").cast("string"), F.lit(" v"))), window)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty", conflict.alias("conflict"))
