"""Scopes and identities of parts: each part is a chunk of a product named by type and size; every 50th part asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import identity
from tessera.plans.dialect import Book
from tessera.sources.tables import table

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS

_CODE = "concat('F', CAST(100 + p_partkey % 700 AS VARCHAR(9)))"
_FIELDS = """p_brand AS manufacturer, p_type AS family, concat(p_type, ' ', {tens}) AS series, concat(p_type, '-', CAST(p_size AS VARCHAR(9))) AS model"""
_ALIASES = "array(concat(p_type, '-', CAST(p_size AS VARCHAR(9))), concat(p_type, ' ', {tens}), concat(p_type, ' ', {tens}, ' series'))"
_SPARK_TENS = "CAST(10 * (p_size DIV 10) AS STRING)"
_KIND = "CASE (p_partkey {div} 50) % 5 WHEN 0 THEN 'EXACT_MODEL' WHEN 1 THEN 'SERIES' WHEN 2 THEN 'FAMILY' WHEN 3 THEN 'UNKNOWN' ELSE 'EXACT_MODEL' END"


def _frames(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, the products that they name (the maker left out by every third, a model without any part by some) and chunks."""
    parts = table(spark, folder, "part")
    fields, aliases = _FIELDS.format(tens=_SPARK_TENS), _ALIASES.format(tens=_SPARK_TENS) + " AS aliases"
    chunks = parts.selectExpr("p_partkey AS chunk_id", *_split(fields), aliases, f"array({_CODE}) AS identifiers")
    asking = parts.where("p_partkey % 50 = 0")
    questions = asking.selectExpr("p_partkey AS query_id", f"{_KIND.format(div='DIV')} AS confidence", "1 AS resolved", f"CASE WHEN p_partkey % 100 = 0 THEN array({_CODE}) END AS identifiers")
    asked = asking.selectExpr("p_partkey AS query_id", "CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS manufacturer", *_split(fields.split(" AS manufacturer, ")[1].replace("CAST(p_size AS VARCHAR(9))) AS model", "CASE WHEN p_partkey % 7 = 0 THEN 'Z9' ELSE CAST(p_size AS STRING) END) AS model")), aliases)
    return questions, asked, chunks


def _split(fields: str) -> list[str]:
    """Expressions of a list, cut after their names."""
    out, rest = [], fields
    for name in ("manufacturer", "family", "series", "model"):
        head, mark, tail = rest.partition(f" AS {name}")
        if mark:
            out.append(head.strip(", ") + mark)
            rest = tail
    return out


SCOPE = f"""
WITH p AS (SELECT p_partkey AS chunk_id, lower(p_brand) AS maker, lower(p_type) AS family, lower(p_type) || ' ' || (10 * (p_size // 10)) AS series, lower(p_type) || ' ' || p_size AS model, {_CODE} AS code FROM part),
q AS (SELECT chunk_id AS query_id, CASE WHEN chunk_id % 3 > 0 THEN maker END AS maker, family, series, CASE WHEN chunk_id % 7 = 0 THEN family || ' z9' ELSE model END AS model, model AS own, code, chunk_id % 100 = 0 AS by_code,
  CASE (chunk_id // 50) % 5 WHEN 0 THEN 'EXACT_MODEL' WHEN 1 THEN 'SERIES' WHEN 2 THEN 'FAMILY' WHEN 3 THEN 'UNKNOWN' ELSE 'EXACT_MODEL' END AS confidence FROM p WHERE chunk_id % 50 = 0),
pair AS (SELECT q.*, p.chunk_id, CASE WHEN q.maker <> p.maker THEN 9 WHEN q.model IN (p.model, p.series, p.series || ' series') THEN 0 WHEN p.model IN (q.own, q.series, q.series || ' series') OR q.series = p.series THEN 1 WHEN q.family = p.family THEN 2 ELSE 9 END AS place, by_code AND p.code = q.code AS hit FROM q, p),
counts AS (SELECT query_id, any_value(confidence) AS confidence, count(*) FILTER (place = 0) AS exact, count(*) FILTER (place <= 1) AS series, count(*) FILTER (place <= 2) AS family, count(*) AS everything, count(*) FILTER (hit) AS identified FROM pair GROUP BY query_id),
decided AS (SELECT *, CASE WHEN confidence = 'EXACT_MODEL' AND exact > 0 THEN 'EXACT_MODEL_SCOPE' WHEN confidence = 'EXACT_MODEL' THEN 'UNKNOWN_SCOPE' WHEN confidence = 'SERIES' THEN 'SERIES_SCOPE' WHEN confidence = 'FAMILY' THEN 'FAMILY_SCOPE' ELSE 'GLOBAL_SCOPE' END AS requested FROM counts)"""


@book.frame("FLT5 IDN4", f"{SCOPE} SELECT query_id, requested, exact, series, family, everything, identified FROM decided")
def identity_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """The scope that each asked part calls for, and how many parts its model, series, family and code have."""
    return identity.scopes(*_frames(spark, folder), 10)[0]


FILL = f"""{SCOPE},
based AS (SELECT p.*, d.requested, CASE WHEN requested = 'EXACT_MODEL_SCOPE' AND place = 0 THEN 1 WHEN requested = 'EXACT_MODEL_SCOPE' AND place <= 2 THEN 2 WHEN requested = 'SERIES_SCOPE' AND (place <= 1 OR (d.series = 0 AND place = 2)) THEN 1
    WHEN requested = 'FAMILY_SCOPE' AND place <= 2 THEN 1 WHEN requested IN ('UNKNOWN_SCOPE', 'GLOBAL_SCOPE') OR d.family = 0 THEN 1 END AS tier, d.family = 0 OR requested = 'UNKNOWN_SCOPE' AS free FROM pair p JOIN decided d USING (query_id)),
inside AS (SELECT *, bool_or(hit AND tier IS NOT NULL) OVER (PARTITION BY query_id) AS any_in FROM based),
tiered AS (SELECT *, CASE WHEN hit AND (tier IS NOT NULL OR NOT any_in) THEN 0 ELSE tier END AS t FROM inside),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY t, chunk_id) AS rank FROM tiered WHERE t IS NOT NULL)
SELECT query_id, rank::INT AS rank, chunk_id, CASE WHEN t = 0 THEN 'IDENTIFIER_SCOPE' WHEN t = 2 THEN 'FAMILY_SCOPE' WHEN free THEN 'GLOBAL_SCOPE' ELSE requested END AS level, t::INT AS tier FROM ranked WHERE rank <= 10"""


@book.frame("FLT4 FLT5 WIN4 RET7", FILL)
def identity_scope_fill(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten parts of each scope, tier by tier: those with the asked code, the model, the family, or all."""
    return identity.scopes(*_frames(spark, folder), 10)[1]


NAMED = """
WITH p AS (SELECT DISTINCT lower(p_brand) AS manufacturer, lower(p_type) AS family, lower(p_type) || ' ' || (10 * (p_size // 10)) AS series, lower(p_type) || ' ' || p_size AS model, lower(p_type) AS word, p_size AS size, 10 * (p_size // 10) AS tens FROM part),
term AS (SELECT manufacturer, family, series, model, unnest([model, series]) AS term FROM p),
q AS (SELECT p_partkey AS query_id, lower(CASE p_partkey // 50 % 3 WHEN 0 THEN 'is the ' || p_type || '-' || p_size || ' heavy' WHEN 1 THEN 'parts of ' || p_type || ' or so' ELSE substr(p_type, 1, 4) || ' with ' || p_size END) AS said FROM part WHERE p_partkey % 50 = 0),
n AS (SELECT query_id, regexp_replace(said, '-', ' ', 'g') AS said FROM q),
w AS (SELECT *, list_filter(regexp_extract_all(said, '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'with')) AS words, regexp_extract_all(said, '[0-9]+') AS numbers FROM n)
SELECT DISTINCT query_id, manufacturer, family, series, model FROM w JOIN term ON regexp_matches(said, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')
   OR (len(list_filter(words, lambda x: starts_with(term, x) AND length(x) >= greatest(3, length(term) // 2))) > 0 AND len(list_filter(numbers, lambda x: NOT list_contains(regexp_extract_all(term, '[0-9]+'), x))) = 0)"""


@book.frame("SUB5", NAMED)
def named_products(spark: SparkSession, folder: str) -> DataFrame:
    """The products that every 50th part's question names: by model, by type alone, or cut short."""
    said = "CASE (p_partkey DIV 50) % 3 WHEN 0 THEN concat('is the ', p_type, '-', p_size, ' heavy') WHEN 1 THEN concat('parts of ', p_type, ' or so') ELSE concat(substr(p_type, 1, 4), ' with ', p_size) END AS text"
    questions = table(spark, folder, "part").where("p_partkey % 50 = 0").selectExpr("p_partkey AS query_id", said)
    return identity.mentioned(questions, _frames(spark, folder)[2])
