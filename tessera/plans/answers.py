"""Answer or abstain: every passage of ``benchmark`` asks all documents, and the evidence found decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ladder
from tessera.operators import lexical as lx
from tessera.operators.identity import IDENTIFIER
from tessera.operators.positions import stands
from tessera.plans.dialect import Book
from tessera.plans.retrieval import BM25, FUSED, SETS, _asked, _corpus
from tessera.session import settled

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS

#: The greatest distance of strong evidence, so many times which requirements that are met still count, and letters of a word that is required.
MOST, RATIO, LETTERS = 0.6, 1.2, 12
_WORD = f"[a-z]{{{LETTERS},}}"

DECIDED = rf"""WITH {BM25}, {SETS}, {FUSED},
q AS (SELECT item_id AS query_id, text AS question, lower(text) AS t, regexp_extract(lower(text), '(?:^|[^a-z0-9])(0x[0-9a-f]+|[faceps][0-9]{{2,5}}|mw[0-9]{{1,5}}|4[0-9]{{4}})(?:[^a-z0-9]|$)', 1) AS code FROM benchmark),
found AS (SELECT r.query_id, r.rank, r.lexical_score, r.lexical_rank, 1 - r.vector_score AS distance, r.vector_rank, lower(d.text) AS text FROM ranked r JOIN documents d ON d.doc_id = r.chunk_id),
held AS (SELECT query_id, count(*) AS n, max(lexical_score) FILTER (rank = 1) AS lexical_score, max(distance) FILTER (rank = 1) AS distance, abs(max(lexical_score) FILTER (lexical_rank = 1) - max(lexical_score) FILTER (lexical_rank = 2)) AS lexical_margin,
  abs(max(distance) FILTER (vector_rank = 1) - max(distance) FILTER (vector_rank = 2)) AS vector_margin, list_distinct(flatten(list(regexp_extract_all(text, '{_WORD}')))) AS words, string_agg(text, ' ') AS everything FROM found GROUP BY query_id),
f AS (SELECT q.*, coalesce(n, 0) AS n, lexical_score, distance, lexical_margin, vector_margin, list_distinct(regexp_extract_all(t, '{_WORD}')) AS wanted, coalesce(words, []) AS words,
  code <> '' AND coalesce(regexp_matches(everything, '(?:^|[^a-z0-9])' || code || '(?:[^a-z0-9]|$)'), false) AS exact FROM q LEFT JOIN held USING (query_id)),
g AS (SELECT *, len(wanted) > 0 AS critical, len(list_filter(wanted, lambda w: NOT list_contains(words, w))) = 0 AS sufficient,
  regexp_matches(question, '(?i)\b(reset|recover|restor|bypass|regain|unlock)') AND regexp_matches(question, '(?i)\b(password|passcode|credential|login|administrator account)') AND regexp_matches(question, '(?i)\b(lost|forgot|forgotten|unknown|cannot|can''t|without|no longer)\b') AS bypass FROM f),
reasons AS (SELECT *, CASE WHEN code <> '' AND NOT exact THEN 'UNKNOWN_IDENTIFIER' WHEN n = 0 THEN 'NO_CANDIDATE' WHEN bypass THEN 'UNSUPPORTED_PROCEDURE' WHEN critical AND NOT sufficient THEN 'MISSING_ATTRIBUTE_EVIDENCE'
  WHEN critical AND coalesce(distance > {MOST} * {RATIO}, false) THEN 'WEAK_RETRIEVAL_EVIDENCE' WHEN exact THEN 'EXACT_IDENTIFIER_EVIDENCE' WHEN critical THEN 'CONTRACT_REQUIREMENTS_COVERED' WHEN distance <= {MOST} THEN 'STRONG_VECTOR_EVIDENCE'
  ELSE 'INSUFFICIENT_EVIDENCE' END AS reason FROM g)
SELECT query_id, n::BIGINT AS n_candidates, round(lexical_score, 6) AS lexical_score, round(distance, 6) AS vector_distance, round(lexical_margin, 6) AS lexical_margin, round(vector_margin, 6) AS vector_margin,
       CASE WHEN reason IN ('EXACT_IDENTIFIER_EVIDENCE', 'CONTRACT_REQUIREMENTS_COVERED', 'STRONG_VECTOR_EVIDENCE') THEN 'ANSWER' ELSE 'ABSTAIN' END AS decision, reason FROM reasons"""


@book.frame("EVD1", DECIDED)
def evidence_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """For every passage: its candidates by both channels, their margins, whether they have its code and its long words, and the decision with its reason."""
    col = F.col
    corpus, asked = _corpus(spark, folder), _asked(spark, folder)
    ranked = settled(lx.hybrid(corpus, asked))
    low = F.lower("text")
    text = corpus.join(ranked.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", low.alias("text"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(_WORD), F.lit(0)))
    questions = asked.select("query_id", col("text").alias("question"), F.lower(F.regexp_extract("text", IDENTIFIER, 0)).alias("error_code"), words(low).alias("wanted"))
    found = ranked.join(text, "chunk_id").join(questions.select("query_id", "error_code"), "query_id").withColumn("distance", 1 - col("vector_score"))
    has_code = (col("error_code") != "") & stands(col("text"), col("error_code"))
    at = lambda rank, k, v: F.max(F.when(col(rank) == k, col(v)))
    gap = lambda rank, v: F.abs(at(rank, 1, v) - at(rank, 2, v))
    held = found.groupBy("query_id").agg(
        F.count("*").alias("n_candidates"), at("rank", 1, "lexical_score").alias("lexical_score"), at("rank", 1, "distance").alias("vector_distance"), gap("lexical_rank", "lexical_score").alias("lexical_margin"),
        gap("vector_rank", "distance").alias("vector_margin"), F.max(has_code).alias("exact_identifier"),
    )
    # A passage's candidates are at most twenty documents; their long words meet the passage's by equality.
    hit = questions.select("query_id", F.explode("wanted").alias("word")).join(found.select("query_id", F.explode(words(col("text"))).alias("word")).distinct(), ["query_id", "word"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    features = questions.join(held, "query_id", "left").join(hit, "query_id", "left").select(
        "query_id", "question", "error_code", "exact_identifier", F.lit(False).alias("has_identity"), F.lit(True).alias("known_identity"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.lit(True).alias("compatible"),
        F.lit(False).alias("foreign"), F.lit(None).cast("string").alias("unknown_parameter"), (F.size("wanted") > 0).alias("critical"), (F.coalesce("hits", F.lit(0)) == F.size("wanted")).alias("sufficient"),
        F.array(F.lit("ATTRIBUTE")).alias("missing"), F.lit(False).alias("unsupported_detail"), "vector_distance", "lexical_score", "lexical_margin", "vector_margin", F.lit("UNKNOWN").alias("relation"),
    )
    rounded = [F.round(c, 6).alias(c) for c in ("lexical_score", "vector_distance", "lexical_margin", "vector_margin")]
    return ladder.decided(features, MOST, RATIO).select("query_id", "n_candidates", *rounded, "decision", "reason")
