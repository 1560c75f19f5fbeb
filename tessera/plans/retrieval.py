"""Retrieval queries: benchmark passages asked of the documents, vectors asked of the embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import lexical as lx
from tessera.operators.dense import nearest
from tessera.plans.dialect import Book, Duck
from tessera.session import settled
from tessera.sources.tables import spread, table

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS
_D = Duck()


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BM25 = f"""
tok AS (SELECT doc_id AS chunk_id, unnest({_D.tokens('text')}) AS token FROM documents),
post AS (SELECT token, chunk_id, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT doc_id AS chunk_id, len({_D.tokens('text')}) AS length FROM documents),
whole AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
asked AS (SELECT item_id AS query_id, unnest({_D.tokens('text')}) AS token FROM benchmark),
bm25 AS (
  SELECT query_id, chunk_id,
         round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
  FROM asked JOIN post USING (token) JOIN df USING (token) JOIN len USING (chunk_id), whole GROUP BY ALL),
lexical AS (
  SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25) WHERE rank <= 10)"""


@book.frame("FN1 AGG1 AGG2 JOIN1 WIN1 TOP1 RET3", f"WITH {BM25} SELECT * FROM lexical")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of each passage by BM25."""
    return lx.top(lx.bm25(_corpus(spark, folder), _asked(spark, folder)), 10).select("query_id", "chunk_id", "score", "rank")


GRAMS = """
norm AS (SELECT doc_id AS chunk_id, regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS t FROM documents),
part AS (SELECT chunk_id, substr(t, k * 400 + 1, 403) AS t FROM (SELECT *, unnest(range((greatest(length(t), 1) - 1) // 400 + 1)) AS k FROM norm)),
gram AS (SELECT chunk_id, substr(t, i, n) AS gram FROM (SELECT *, unnest(range(1, least(400, length(t) - n + 1) + 1)) AS i FROM part, (VALUES (2), (3), (4)) AS s(n))),
tf AS (SELECT chunk_id, gram, count(*) AS tf FROM gram GROUP BY ALL),
vocab AS (SELECT gram, sum(tf) AS every, count(*) AS df FROM tf GROUP BY gram ORDER BY every DESC, gram LIMIT 15000),
raw AS (SELECT chunk_id, gram, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN vocab USING (gram)),
weight AS (SELECT chunk_id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS weight FROM raw)"""


@book.frame("AGG3 TOP2", f"WITH {GRAMS} SELECT chunk_id, count(*) AS n, round(sum(weight), 4) AS total, round(max(weight), 6) AS top FROM weight GROUP BY chunk_id")
def char_gram_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Character n-gram vectors of the documents' whole texts, summed up."""
    w = lx.gram_weights(spread(_corpus(spark, folder)))
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return w.select("chunk_id", F.size("places").cast("long").alias("n"), F.round(total, 4).alias("total"), F.round(F.array_max("weights"), 6).alias("top"))


ASKED_GRAMS = """
qnorm AS (SELECT item_id AS query_id, regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS t FROM benchmark),
qtf AS (SELECT query_id, substr(t, i, n) AS gram, count(*) AS tf FROM (SELECT *, unnest(range(1, length(t) - n + 2)) AS i FROM qnorm, (VALUES (2), (3), (4)) AS s(n)) GROUP BY ALL),
qraw AS (SELECT query_id, gram, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w FROM qtf JOIN vocab USING (gram)),
qweight AS (SELECT query_id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS asked FROM qraw),
near AS (SELECT query_id, chunk_id, round(sum(asked * weight), 6) AS score FROM qweight JOIN weight USING (gram) GROUP BY ALL)"""


@book.frame("RET4 AGG3 TOP2", f"WITH {GRAMS}, {ASKED_GRAMS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near) WHERE rank <= 10")
def gram_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents nearest to each passage by the cosine of character n-grams of whole texts."""
    return lx.gram_top(spread(_corpus(spark, folder)), _asked(spark, folder), 10)


def _every_50th(spark: SparkSession, folder: str, cosine: bool) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10, cosine)


def _ten(score: str, order: str) -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, {score} FROM q JOIN embeddings e ON q.query_id <> e.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, vec_id) AS rank FROM s) WHERE rank <= 10"""


@book.frame("RET5 WIN2", _ten(f"round({_D.squared('a', 'embedding')}, 6) AS distance", "distance"))
def dense_l2_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every 50th one by squared distance, ties to the least id; itself excluded."""
    return _every_50th(spark, folder, cosine=False).withColumnRenamed("score", "distance")


@book.frame("WIN2", _ten(f"round({_D.dot('a', 'embedding')} / sqrt({_D.dot('a', 'a')} * {_D.dot('embedding', 'embedding')}), 6) AS score", "score DESC"))
def dense_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar vectors of every 50th one by cosine."""
    return _every_50th(spark, folder, cosine=True)


SETS = f"""
bag AS (SELECT doc_id AS chunk_id, list_distinct({_D.tokens('text')}) AS a FROM documents),
need AS (SELECT item_id AS query_id, list_distinct({_D.tokens('text')}) AS b FROM benchmark),
hit AS (SELECT query_id, chunk_id, count(*) AS n FROM (SELECT query_id, unnest(b) AS token FROM need) JOIN (SELECT chunk_id, unnest(a) AS token FROM bag) USING (token) GROUP BY ALL),
overlap AS (SELECT query_id, chunk_id, round(n / sqrt(len(a)::DOUBLE * len(b)), 6) AS score FROM hit JOIN bag USING (chunk_id) JOIN need USING (query_id)),
vector AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM overlap) WHERE rank <= 10)"""


FUSED = """
fused AS (
  SELECT query_id, chunk_id, l.rank AS lexical_rank, l.score AS lexical_score, v.rank AS vector_rank, v.score AS vector_score,
         round(coalesce(1 / (60 + l.rank)::DOUBLE, 0) + coalesce(1 / (60 + v.rank)::DOUBLE, 0), 9) AS score
  FROM lexical l FULL JOIN vector v USING (query_id, chunk_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused)"""


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    """Two channels: BM25, and the cosine of token sets, as no embedding of text is at hand."""
    return lx.hybrid(_corpus(spark, folder), _asked(spark, folder))


@book.frame("JOIN2 AGG4 WIN3 SET4 RET6 RET1", f"WITH {BM25}, {SETS}, {FUSED} SELECT * FROM ranked")
def rrf_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """Two channels fused by reciprocal ranks."""
    return _fused(spark, folder)


GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
METRICS = """
best AS (SELECT query_id, min(rank) AS best FROM ranked JOIN gold USING (query_id, chunk_id) GROUP BY query_id),
need AS (SELECT DISTINCT query_id FROM gold)
SELECT count(*) AS n, avg((coalesce(best, 99) = 1)::INT) AS hit_1, avg((coalesce(best, 99) <= 3)::INT) AS hit_3, round(avg(coalesce(1 / best::DOUBLE, 0)), 6) AS mrr
FROM need LEFT JOIN best USING (query_id)"""


#: Bytes of passages that are sent to the documents; more meet them by an anchor word.
PASSAGES = 8 << 20


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, chunk_id): the documents that hold a passage as it is.

    Passages of up to PASSAGES bytes are looked for, all at once, where the documents are read. Beyond
    that candidates share a rare anchor with the passage (its longest inner word), so that
    no document meets every passage; containment is tested on candidates alone.
    """
    passages = table(spark, folder, "benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = spread(table(spark, folder, "documents")).where("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), "text")
    if (passages.agg(F.sum(F.octet_length("passage") + 64)).first()[0] or 0) <= PASSAGES:
        held: dict[str, list[int]] = {}
        for r in passages.collect():
            held.setdefault(r["passage"], []).append(r["query_id"])
        return contained(docs, held)
    # A passage starts and ends anywhere in a document, but its inner words are whole there.
    inner = F.expr("slice(split(passage, ' '), 2, greatest(size(split(passage, ' ')) - 2, 0))")
    passages = passages.withColumn("word", F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"])
    words = docs.select("chunk_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    pairs = words.join(passages.select("query_id", "word"), "word").select("query_id", "chunk_id").distinct()
    return pairs.join(passages, "query_id").join(docs, "chunk_id").where(F.contains("text", "passage")).select("query_id", "chunk_id")


def contained(docs: DataFrame, passages: dict[str, list[int]]) -> DataFrame:
    """(query_id, chunk_id) of all ``passages`` (their ids by text) in ``docs`` (chunk_id, text), by one automaton. An empty passage is in every text."""
    kind = docs.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        find = ahocorasick.Automaton()
        for text, ids in passages.items():
            if text:
                find.add_word(text, ids)
        find.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = set(passages.get("", ()))
                if len(find):
                    own.update(q for _, ids in find.iter(text) for q in ids)
                rows += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column("chunk_id").take(pa.array(rows, pa.int64()))], names=["query_id", "chunk_id"])

    return docs.mapInArrow(run, f"query_id bigint, chunk_id {kind}")


@book.frame("JOIN11 AGG5 AGG7 WIN17 WIN18", f"WITH {BM25}, {SETS}, {FUSED}, {GOLD}, {METRICS}".replace("need AS (SELECT item_id", "need0 AS (SELECT item_id").replace("unnest(b) AS token FROM need)", "unnest(b) AS token FROM need0)").replace("JOIN need USING (query_id)),\nvector", "JOIN need0 USING (query_id)),\nvector"))
def hybrid_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Hit@1, hit@3 and mean reciprocal rank of the fused list against the documents that hold the passage."""
    held = settled(gold(spark, folder))
    best = _fused(spark, folder).join(held, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("best"))
    joined = held.select("query_id").distinct().join(best, "query_id", "left")
    return joined.agg(
        F.count("*").alias("n"), F.avg((F.coalesce("best", F.lit(99)) == 1).cast("int")).alias("hit_1"),
        F.avg((F.coalesce("best", F.lit(99)) <= 3).cast("int")).alias("hit_3"), F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 6).alias("mrr"),
    )


@book.frame("FLT6 FLT8", f"WITH {BM25}, {SETS}, {FUSED} SELECT query_id, chunk_id, rank FROM ranked WHERE (vector_score IS NOT NULL AND 1 - vector_score <= 0.81) OR (vector_score IS NULL AND lexical_score > 0)")
def relevance_filter_light(spark: SparkSession, folder: str) -> DataFrame:
    """Fused rows close enough by the vector channel, or lexical where it has none."""
    v, x = F.col("vector_score"), F.col("lexical_score")
    return _fused(spark, folder).where((v.isNotNull() & (1 - v <= 0.81)) | (v.isNull() & (x > 0))).select("query_id", "chunk_id", "rank")


@book.frame("FLT7 RET2", f"WITH {BM25}, {SETS}, {FUSED} SELECT query_id, chunk_id, rank FROM ranked WHERE coalesce(lexical_score, 0) > 0 OR coalesce(1 - vector_score <= 20, false)")
def relevance_filter_full(spark: SparkSession, folder: str) -> DataFrame:
    """Fused rows with a lexical score, or a distance up to the full mode's ceiling."""
    near = F.coalesce(1 - F.col("vector_score") <= 20, F.lit(False))
    return _fused(spark, folder).where((F.coalesce("lexical_score", F.lit(0.0)) > 0) | near).select("query_id", "chunk_id", "rank")


@book.frame("", f"""WITH {BM25}, {SETS}, {FUSED},
five AS (SELECT query_id, chunk_id, rank AS before, coalesce(vector_score, 0) AS stand_in FROM ranked WHERE rank <= 5),
again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stand_in DESC, before, chunk_id) AS after FROM five)
SELECT query_id, chunk_id, before, after, CASE WHEN after < before THEN 'IMPROVED' WHEN after > before THEN 'DEGRADED' ELSE 'SAME' END AS outcome FROM again WHERE after <= 3""")
def rerank_top3(spark: SparkSession, folder: str) -> DataFrame:
    """The first five reordered by a stand-in scorer (no model is at hand), cut to three, with each one's change of rank."""
    five = _fused(spark, folder).where("rank <= 5").select("query_id", "chunk_id", F.col("rank").alias("before"), F.coalesce("vector_score", F.lit(0.0)).alias("s"))
    after = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("s"), "before", "chunk_id")).cast("long")
    outcome = F.when(F.col("after") < F.col("before"), "IMPROVED").when(F.col("after") > F.col("before"), "DEGRADED").otherwise("SAME")
    return five.withColumn("after", after).where("after <= 3").select("query_id", "chunk_id", "before", "after", outcome.alias("outcome"))


@book.frame("AGG39", f"WITH {BM25} SELECT query_id, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 5) AS margin FROM lexical GROUP BY query_id")
def lexical_margin(spark: SparkSession, folder: str) -> DataFrame:
    """How far the first document is from the second; null where there is one alone."""
    found = lx.top(lx.bm25(_corpus(spark, folder), _asked(spark, folder)), 2)
    pick = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return found.groupBy("query_id").agg(F.round(pick(1) - pick(2), 5).alias("margin"))


@book.both("FN1 AGG1")
def token_df_idf(d):
    """Document frequency and idf of every token that at least two documents have."""
    return f"""
    WITH n AS (SELECT count(*) AS n FROM {d.t('documents')}),
    p AS (SELECT token, count(*) AS df FROM (SELECT doc_id, {d.explode(d.distinct(d.tokens('text')))} AS token FROM {d.t('documents')}) x GROUP BY token)
    SELECT token, df, round(ln(1 + (n - df + {d.d('0.5')}) / (df + {d.d('0.5')})), 6) AS idf FROM p, n WHERE df > 1"""


# Words that name no section, and short words that may.
GENERAL = ("powerflex", "compactlogix", "controller", "controllers", "drive", "drives")
SHORT = ("ip", "dc")

SECTIONS = f"""
term AS (SELECT DISTINCT item_id AS query_id, token FROM (SELECT item_id, unnest({_D.tokens('text')}) AS token FROM benchmark)
         WHERE (length(token) > 1 OR token IN {SHORT}) AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN {GENERAL}),
line AS (SELECT doc_id AS chunk_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
line_tf AS (SELECT chunk_id, pos, token, count(*) AS tf FROM (SELECT chunk_id, pos, unnest({_D.tokens('line')}) AS token FROM line) GROUP BY ALL),
part AS (SELECT query_id, chunk_id, pos, sum(1 + ln(1 + tf)) AS overlap FROM term JOIN line_tf USING (token) SEMI JOIN lexical USING (query_id, chunk_id) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY overlap DESC, pos) AS k FROM part),
section AS (SELECT query_id, chunk_id, round(coalesce(1.5 * sum(overlap) FILTER (pos = 0), 0) + sum(overlap * CASE k WHEN 1 THEN 1 WHEN 2 THEN 0.3::DOUBLE WHEN 3 THEN 0.1::DOUBLE ELSE 0 END), 6) AS score FROM best GROUP BY ALL)"""


@book.frame("FN2 FN3 FN4 TOP3 JOIN6 WIN5", f"WITH {BM25}, {SECTIONS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM section) WHERE rank <= 2")
def section_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The two best sections of each passage among the documents that BM25 allows it.

    A document is a section: its first line is the title, its lines are the chunks. Terms
    are the passage's distinct tokens but digits, single characters and general words; an
    overlap sums 1 + ln(1 + tf); a section scores 1.5 times its title's overlap, and its
    three best chunks' times 1, 0.3 and 0.1.
    """
    corpus, asked = _corpus(spark, folder), _asked(spark, folder)
    allowed = settled(lx.top(lx.bm25(corpus, asked), 10).select("query_id", "chunk_id"))
    t = F.col("token")
    terms = asked.select("query_id", F.explode(F.array_distinct(lx.tokens(F.col("text")))).alias("token"))
    terms = terms.where(((F.length(t) > 1) | t.isin(*SHORT)) & ~t.rlike("^[0-9]+$") & ~t.isin(*GENERAL))
    # Only allowed documents are cut into lines.
    lines = corpus.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    tf = lines.select("chunk_id", "pos", F.explode(lx.tokens(F.col("line"))).alias("token")).groupBy("chunk_id", "pos", "token").agg(F.count("*").alias("tf"))
    part = tf.join(allowed, "chunk_id").join(terms, ["query_id", "token"]).groupBy("query_id", "chunk_id", "pos").agg(F.sum(1 + F.log1p("tf")).alias("overlap"))
    k = F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy(F.desc("overlap"), "pos"))
    weight = F.when(F.col("k") == 1, 1.0).when(F.col("k") == 2, 0.3).when(F.col("k") == 3, 0.1).otherwise(0.0) + F.when(F.col("pos") == 0, 1.5).otherwise(0.0)
    scored = part.withColumn("k", k).groupBy("query_id", "chunk_id").agg(F.sum(F.col("overlap") * weight).alias("score"))
    return lx.top(scored, 2)


@book.both("EXP20 HAR2")
def lexical_coverage_072(d):
    """Passages and documents where at least 0.72 of the passage's distinct tokens occur."""
    return f"""
    WITH q AS (SELECT item_id, {d.distinct(d.tokens('text'))} AS b FROM {d.t('benchmark')}),
    qe AS (SELECT item_id, {d.size('b')} AS nb, {d.explode('b')} AS token FROM q),
    de AS (SELECT doc_id, {d.explode(d.distinct(d.tokens('text')))} AS token FROM {d.t('documents')}),
    h AS (SELECT item_id, doc_id, nb, count(*) AS n FROM qe JOIN de ON qe.token = de.token GROUP BY item_id, doc_id, nb)
    SELECT item_id, doc_id, round(n / {d.d('nb')}, 6) AS coverage FROM h WHERE n / {d.d('nb')} >= 0.72"""


@book.both("HAR4")
def leakage_overlap_coef(d):
    """Overlap coefficient of token sets (shared over the smaller set) from 0.8: passages that leaked into documents."""
    return f"""
    WITH q AS (SELECT item_id, {d.distinct(d.tokens('text'))} AS b FROM {d.t('benchmark')}),
    s AS (SELECT doc_id, {d.distinct(d.tokens('text'))} AS a FROM {d.t('documents')}),
    qe AS (SELECT item_id, {d.size('b')} AS nb, {d.explode('b')} AS token FROM q),
    de AS (SELECT doc_id, {d.size('a')} AS na, {d.explode('a')} AS token FROM s),
    h AS (SELECT item_id, doc_id, least(na, nb) AS m, count(*) AS n FROM qe JOIN de ON qe.token = de.token GROUP BY item_id, doc_id, least(na, nb))
    SELECT item_id, doc_id, round(n / {d.d('m')}, 6) AS overlap FROM h WHERE n / {d.d('m')} >= 0.8"""


@book.both("HAR1 HAR3")
def passage_similarity_class(d):
    """Passage pairs as exact, normalised or near (token Jaccard from 0.8, both with five tokens or more)."""
    return f"""
    WITH q AS (SELECT item_id, text, lower(trim({d.sub('text', '[^A-Za-z0-9]+', ' ')})) AS norm, {d.distinct(d.tokens('text'))} AS b FROM {d.t('benchmark')}),
    e AS (SELECT item_id, {d.size('b')} AS nb, {d.explode('b')} AS token FROM q),
    h AS (SELECT x.item_id AS a, y.item_id AS b, x.nb + y.nb - count(*) AS u, count(*) AS n, least(x.nb, y.nb) AS m FROM e x JOIN e y ON x.token = y.token AND x.item_id <= y.item_id
          GROUP BY x.item_id, y.item_id, x.nb, y.nb)
    SELECT h.a, h.b, round(n / {d.d('u')}, 6) AS jaccard, CASE WHEN p.text = r.text THEN 'exact' WHEN p.norm = r.norm THEN 'normalised' ELSE 'near' END AS kind
    FROM h JOIN q p ON p.item_id = h.a JOIN q r ON r.item_id = h.b WHERE n / {d.d('u')} >= 0.8 AND m >= 5"""


@book.both("HAR34 JOIN4")
def all_any_word_coverage(d):
    """For each passage: how many documents hold all of its words, and any."""
    return f"""
    WITH q AS (SELECT item_id, {d.distinct(d.tokens('text'))} AS b FROM {d.t('benchmark')}),
    qe AS (SELECT item_id, {d.size('b')} AS nb, {d.explode('b')} AS token FROM q),
    de AS (SELECT doc_id, {d.explode(d.distinct(d.tokens('text')))} AS token FROM {d.t('documents')}),
    h AS (SELECT item_id, doc_id, nb, count(*) AS n FROM qe JOIN de ON qe.token = de.token GROUP BY item_id, doc_id, nb)
    SELECT item_id, {d.i('sum(CASE WHEN n = nb THEN 1 ELSE 0 END)')} AS all_words, count(*) AS any_word FROM h GROUP BY item_id"""


@book.both("HAR33 SET7")
def coverage_index(d):
    """Identifier-like tokens: how many documents and sources have each, with the sources in order."""
    return f"""
    WITH e AS (SELECT doc_id, source, {d.explode(d.distinct(d.find_all('lower(text)', '[a-z]+[-_.]?[0-9][a-z0-9]*')))} AS token FROM {d.t('documents')}),
    p AS (SELECT DISTINCT token, source FROM e), c AS (SELECT token, count(*) AS docs FROM e GROUP BY token)
    SELECT c.token, c.docs, s.n AS sources, s.listed FROM c JOIN (SELECT token, count(*) AS n, {d.listed('source', ',', 'source')} AS listed FROM p GROUP BY token) s ON c.token = s.token"""


@book.both("AGG21 AGG22 WIN17 RET13")
def stage_survival(d):
    """How many relevant rows are left after cuts at 10, 5 and 3 of a ranking by overlap, and where each passage first loses its own."""
    return f"""
    WITH q AS (SELECT item_id, {d.distinct(d.tokens('text'))} AS b FROM {d.t('benchmark')}),
    qe AS (SELECT item_id, {d.explode('b')} AS token FROM q),
    de AS (SELECT doc_id, {d.explode(d.distinct(d.tokens('text')))} AS token FROM {d.t('documents')}),
    h AS (SELECT item_id, doc_id, count(*) AS n FROM qe JOIN de ON qe.token = de.token GROUP BY item_id, doc_id),
    r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM h),
    g AS (SELECT r.item_id, min(rank) AS best FROM r JOIN {d.t('benchmark')} b ON b.item_id = r.item_id JOIN {d.t('documents')} x ON x.doc_id = r.doc_id
          WHERE contains(x.text, b.text) GROUP BY r.item_id)
    SELECT item_id, {d.i('best')} AS best, best <= 10 AS at_10, best <= 5 AS at_5, best <= 3 AS at_3,
           CASE WHEN best > 10 THEN 'retrieval' WHEN best > 5 THEN 'fusion' WHEN best > 3 THEN 'final' ELSE 'kept' END AS lost_at FROM g"""
