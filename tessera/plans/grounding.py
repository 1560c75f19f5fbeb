"""Metadata from text, citations, claim binding, grounded answers and follow-up questions.

Technical sentences and labelled lines are spelled out of ``part`` (see ``decisions``);
citations, verdicts and conversations come from the other test tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scan import blocked, running
from tessera.plans.decisions import SCORED, TABLES, each, hits
from tessera.plans.dialect import Book, Spark
from tessera.sources.tables import spread, table

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS

def heads(d):
    """h: a manual's name and first lines for each part; some lack a maker, a version, or all lines."""
    n = lambda x: f"CAST({x} AS VARCHAR(20))"
    nl = "' || chr(10) || '"
    return f"""h AS (SELECT CASE p_partkey % 3 WHEN 0 THEN lower(replace(p_brand, '#', '')) || '_ax' || {n('p_partkey')} || '_v' || {n('p_size')} || '.pdf' ELSE 'f' || {n('p_partkey')} END AS name, p_partkey, p_brand, p_size,
      CASE p_partkey % 4 WHEN 0 THEN 'Manufacturer: ' || p_brand || '{nl}Model: AX-' || {n('p_size')} || '{nl}Version: 2.' || {n('p_size')} || '{nl}Published: 2021-03-' || {n('10 + p_partkey % 19')} || '{nl}Drive manual'
           WHEN 1 THEN 'Model: BR-' || {n('p_size')} || '{nl}Published: 2019-11-' || {n('10 + p_partkey % 19')} || '{nl}Brake sheet' WHEN 2 THEN 'Drive AX-' || {n('p_size')} || '{nl}Version: 3.0.' || {n('p_size')} ELSE '' END AS text FROM {d.t('part')})"""


def labelled(d, label):
    return f"trim({d.find('text', label + ': ?([^' + chr(10) + ']*)', 1)})"


@book.both("ING4 ING5 ING6 ING8 ING9")
def labelled_lines(d):
    """Manufacturer, model, version and date from labelled lines, and the kind of equipment by words; '' where there is none."""
    return f"""
    WITH {heads(d)} SELECT p_partkey, name, {labelled(d, 'Manufacturer')} AS manufacturer, {labelled(d, 'Model')} AS model, {labelled(d, 'Version')} AS version, {labelled(d, 'Published')} AS published,
      CASE WHEN contains(lower(text), 'drive') THEN 'drive' WHEN contains(lower(text), 'brake') THEN 'brake' ELSE '' END AS equipment FROM h"""


@book.both("ING15 ING16 SUB61")
def filename_identity(d):
    """Identity from file names by templates, filling only what is absent: a blank that is present stays."""
    return f"""
    WITH {heads(d)}, m AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS given_maker, CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'BR' END AS given_series FROM h)
    SELECT p_partkey, name, coalesce(given_maker, {d.find('name', '^([a-z]+[0-9]*)_', 1)}) AS maker, coalesce(given_series, upper({d.find('name', '_([a-z]+)[0-9]+', 1)})) AS series FROM m"""


@book.both("FN5 FN6")
def identity_keys(d):
    """Names with hyphens and spaces as one space, edges without punctuation, lower case: parts that share a key."""
    key = f"trim({d.sub('lower(p_name)', '[-_ ,;:]+', ' ')})"
    return f"SELECT {key} AS name_key, count(*) AS parts, min(p_partkey) AS first_part FROM {d.t('part')} GROUP BY {key}"


@book.both("FN11 FN26 SUB40 SUB41")
def concept_terms(d):
    """The concepts that each question touches, by rules, in order, added to its words."""
    rules = {"fault": "fault|error", "bus": "bus|modbus|canopen", "torque": "torque|nm", "safety": "gloves|safety|bypass"}
    union = " UNION ALL ".join(f"SELECT ask, '{n}' AS concept FROM a WHERE {d.has('lower(question)', p)}" for n, p in rules.items())
    return f"WITH {TABLES(d)}, u AS ({union}) SELECT ask, {d.listed('concept', ',', 'concept')} AS concepts, count(*) AS n FROM u GROUP BY ask"


@book.both("FN30 FLT9")
def enum_clamp(d):
    """Values outside a list become 'general'; aliases of retrieval modes their names."""
    return f"""
    SELECT lang, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'general' END AS clamped, CASE lang WHEN 'en' THEN 'lexical' WHEN 'de' THEN 'vector' ELSE 'hybrid' END AS mode, count(*) AS n FROM {d.t('documents')} GROUP BY lang"""


@book.both("FLT17 SRC5")
def scoped_vector_search(d):
    """The five nearest vectors within a label's scope, which becomes a filter of the scan: the query's own label."""
    return f"""
    WITH q AS (SELECT vec_id AS query_id, label AS scope, embedding AS a FROM {d.t('embeddings')} WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id, round({d.squared('a', 'embedding')}, 6) AS distance FROM q JOIN {d.t('embeddings')} e ON e.label = q.scope AND e.vec_id <> q.query_id)
    SELECT * FROM (SELECT query_id, vec_id, distance, {d.i('row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)')} AS rank FROM s) x WHERE rank <= 5"""


@book.both("FN40 EXP29 SUB50 SUB52")
def relation_direction(d):
    """Whether a chunk names its model before its value, and how far apart they stand."""
    return f"""
    WITH {TABLES(d)}, p AS (SELECT chunk_id, model, {d.find('text', '[0-9]+(?:[.][0-9]+)? (?:V|Nm|kg|baud)')} AS value, text FROM c WHERE model <> '')
    SELECT chunk_id, model, value, {d.i('instr(text, model)')} AS model_at, {d.i('instr(text, value)')} AS value_at, instr(text, model) > 0 AND instr(text, model) < instr(text, value) AS model_first FROM p WHERE value <> ''"""


@book.both("FN44 EXP6 SUB31")
def citation_check(d):
    """Citations of an answer that are among its sources, out-of-range ones dropped; the first source where none is left.

    An answer stands for each event: it cites two sources by the event's own numbers and was given one to three.
    """
    n = lambda x: f"CAST({x} AS VARCHAR(20))"
    return f"""
    WITH x AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'No sources here.' ELSE 'Set P12 [S' || {n('event_id % 5')} || ']. See [S' || {n('1 + user_id % 6')} || '].' END AS answer, 1 + event_id % 3 AS sources FROM {d.t('events')} WHERE user_id IS NOT NULL),
    c AS (SELECT id, sources, {d.explode(d.distinct(d.find_all('answer', '\\[S([0-9]+)\\]', 1)))} AS k FROM x),
    ok AS (SELECT id, {d.listed("'S' || k", ',', 'k')} AS cited FROM c WHERE CAST(k AS INT) BETWEEN 1 AND sources GROUP BY id)
    SELECT x.id, coalesce(ok.cited, 'S1') AS cited, ok.id IS NULL AS is_fallback FROM x LEFT JOIN ok ON x.id = ok.id"""


CLASS = "CASE WHEN a.model <> '' AND c.model = a.model OR a.code <> '' AND contains(c.text, a.code) THEN 'PROTECTED' WHEN n >= 2 THEN 'NORMAL' ELSE 'EXPANSION' END"


@book.both("RET10 RET11")
def preservation_class(d):
    """Which candidates an expansion must keep: those with the asked model or code are protected."""
    return f"""
    WITH {TABLES(d)}, {SCORED(d)}
    SELECT hits.ask, hits.chunk_id, {CLASS} AS class
    FROM hits JOIN a ON hits.ask = a.ask JOIN c ON hits.chunk_id = c.chunk_id"""


@book.runs(preservation_class)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return each(hits(spark, folder).selectExpr("a.asks", "c.chunk_id", f"{CLASS} AS class"), ["chunk_id", "class"])


def _seen(d) -> str:
    return f"CASE WHEN a.model <> '' AND c.series = {d.find('a.model', '^[A-Z]+')} AND c.series <> '' THEN a.model ELSE c.model END AS model"


def _rewritten(d) -> str:
    return f"a.model <> '' AND c.series = {d.find('a.model', '^[A-Z]+')} AND c.model <> a.model AS rewritten"


@book.both("IDN9 IDN10 SUB63")
def aligned_view(d):
    """Candidate chunks as a question sees them: the model rewritten to the asked one where its series is the same, and only there."""
    return f"""
    WITH {TABLES(d)}, {SCORED(d)} SELECT a.ask, c.chunk_id, {_seen(d)},
      {_rewritten(d)} FROM a JOIN hits ON a.ask = hits.ask JOIN c ON hits.chunk_id = c.chunk_id"""


@book.runs(aligned_view)
def _(spark: SparkSession, folder: str) -> DataFrame:
    d = Spark(spark, folder)
    return each(hits(spark, folder).selectExpr("a.asks", "c.chunk_id", _seen(d), _rewritten(d)), ["chunk_id", "model", "rewritten"])


@book.both("IDN11 IDN12")
def claim_binding(d):
    """The document that owns a question's terms: bound if a single one has the most, ambiguous if several do."""
    return f"""
    WITH {TABLES(d)}, {SCORED(d)}, n AS (SELECT hits.ask, c.doc, sum(hits.n) AS score FROM hits JOIN c ON hits.chunk_id = c.chunk_id GROUP BY hits.ask, c.doc),
    r AS (SELECT *, max(score) OVER (PARTITION BY ask) AS best FROM n)
    SELECT ask, min(doc) AS doc, count(*) AS owners, CASE WHEN count(*) = 1 THEN 'BOUND' ELSE 'AMBIGUOUS' END AS binding FROM r WHERE score = best GROUP BY ask"""


@book.runs(claim_binding)
def _(spark: SparkSession, folder: str) -> DataFrame:
    n = hits(spark, folder).groupBy("a.ask", "c.doc").agg(F.first("a.asks").alias("asks"), F.sum("n").alias("score"))
    of = n.groupBy("ask", "score").agg(F.first("asks").alias("asks"), F.min("doc").alias("doc"), F.count("*").alias("owners"))
    best = of.groupBy("ask").agg(F.first("asks").alias("asks"), F.max(F.struct("score", "doc", "owners")).alias("x"))
    return each(best.selectExpr("asks", "x.doc", "x.owners", "CASE WHEN x.owners = 1 THEN 'BOUND' ELSE 'AMBIGUOUS' END AS binding"), ["doc", "owners", "binding"])


@book.both("EXP5 EXP15 SUB15 SUB24 SUB32")
def decision_modes(d):
    """Which way each question takes: verify alone, extract alone, or extract and then verify; the two ways as one union."""
    kind = f"CASE WHEN {d.has('lower(question)', '^(?:is|are|does|do|should|can) ')} THEN 'VERIFIER_ONLY' WHEN model <> '' THEN 'EXTRACT_THEN_VERIFY' ELSE 'EXTRACT_ONLY' END"
    return f"""
    WITH {TABLES(d)}, m AS (SELECT ask, {kind} AS mode, {d.has('lower(question)', 'bypass')} AS stopped FROM a)
    SELECT ask, mode, 'verifier' AS way FROM m WHERE NOT stopped AND mode <> 'EXTRACT_ONLY' UNION ALL SELECT ask, mode, 'extractor' FROM m WHERE NOT stopped AND mode <> 'VERIFIER_ONLY'"""


@book.both("EXP13 EXP14 SUB16 SUB34 SUB35")
def open_question_support(d):
    """Sentences that hold a question's model and one of its long words: one is enough to answer."""
    return f"""
    WITH {TABLES(d)}, s AS ({d.places('chunk_id, model', d.split('text', '[.] '), 'c', 'k', 'sentence')}),
    w AS (SELECT ask, model, {d.explode(d.distinct(d.find_all('lower(question)', '[a-z]{5,}')))} AS word FROM a WHERE model <> '')
    SELECT w.ask, count(DISTINCT s.chunk_id) AS chunks, count(DISTINCT word) AS words, count(*) > 0 AS sufficient FROM w JOIN s ON s.model = w.model AND contains(lower(s.sentence), w.word) GROUP BY w.ask"""


@book.both("EXP18 SUB38 SUB39")
def judge_json(d):
    """Verdicts in JSON (a customer's segment and balance as state and confidence) parsed and held against their schema; what breaks it, in order."""
    return f"""
    WITH x AS (SELECT c_custkey AS id, '{{' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '"confidence": "' || CAST(round(c_acctbal / 7000, 2) AS VARCHAR(20)) || '", ' END || '"state": "' || CASE c_custkey % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'refuted' WHEN 2 THEN 'unknown' ELSE lower(c_mktsegment) END || '"}}' AS js FROM {d.t('customer')}),
    p AS (SELECT id, {d.json('js', 'state')} AS state, {d.json('js', 'confidence')} AS confidence FROM x),
    e AS (SELECT id, 'a_state' AS error FROM p WHERE coalesce(state, '') NOT IN ('supported', 'refuted', 'unknown') UNION ALL SELECT id, 'b_missing' FROM p WHERE confidence IS NULL
      UNION ALL SELECT id, 'c_range' FROM p WHERE confidence IS NOT NULL AND ({d.d('confidence')} > 1 OR {d.d('confidence')} < 0))
    SELECT p.id, e.errors IS NULL AS valid, coalesce(e.errors, '') AS errors FROM p LEFT JOIN (SELECT id, {d.listed('error', '+', 'error')} AS errors FROM e GROUP BY id) e ON p.id = e.id"""


BOUND = "target AND relation AND attribute AND value"


def _parts(d) -> list[str]:
    asked = d.find("lower(question)", "(torque|bus|ramp time|fault|voltage)", 1)
    return [
        "c.model = a.model AND a.model <> '' AS target", f"{d.has('text', 'supports|has a|sets|means')} AS relation",
        f"{asked} <> '' AND contains(lower(text), {asked}) AS attribute", f"{d.has('text', '[0-9] (?:V|Nm|kg|baud|s)')} AS value",
    ]


def _held(d) -> str:
    return d.i(" + ".join(f"CASE WHEN {part} THEN 1 ELSE 0 END" for part in ("target", "relation", "attribute", "value")))


@book.both("EXP25 EXP40 SUB42 SUB44 SUB45 SUB46")
def four_part_binding(d):
    """Target, relation, attribute and value found together in a candidate chunk, as four flags and how many hold."""
    target, relation, attribute, value = _parts(d)
    return f"""
    WITH {TABLES(d)}, {SCORED(d)}, b AS (SELECT a.ask, c.chunk_id, {target}, {relation},
      {attribute}, {value} FROM a JOIN hits ON a.ask = hits.ask JOIN c ON hits.chunk_id = c.chunk_id)
    SELECT ask, chunk_id, {_held(d)} AS held, {BOUND} AS bound FROM b"""


@book.runs(four_part_binding)
def _(spark: SparkSession, folder: str) -> DataFrame:
    d = Spark(spark, folder)
    b = hits(spark, folder).selectExpr("a.asks", "c.chunk_id", *_parts(d))
    return each(b.selectExpr("asks", "chunk_id", f"{_held(d)} AS held", f"{BOUND} AS bound"), ["chunk_id", "held", "bound"])


@book.both("CNV4 SUB88")
def follow_up_rewrite(d):
    """Turns that begin with a pronoun or 'and', with the last earlier topic of their conversation put before them; 1,000 characters of a turn are the limit of a query."""
    last = d.last("CASE WHEN topic <> '' THEN topic END")
    return f"""
    WITH t AS (SELECT conv_id, turn, text, {d.find('lower(text)', '[a-z]{7,}')} AS topic, {d.has('lower(text)', '^(?:it|this|that|they|and|the|is) ')} AS follows FROM {d.t('conversations')} WHERE role = 'user'),
    c AS (SELECT *, {last} OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM t)
    SELECT conv_id, turn, follows, CASE WHEN follows AND earlier IS NOT NULL THEN earlier || ': ' || substr(text, 1, 1000) ELSE substr(text, 1, 1000) END AS standalone FROM c"""


@book.both("")
def header_paths(d):
    """The path of headings above each line of a page, from the highest level down."""
    level = lambda k: d.last(f"CASE WHEN level = {k} THEN heading END") + " OVER (PARTITION BY page_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
    WITH l AS ({d.places('page_id', d.split('html', '<'), d.t('pages'), 'line', 'content')}),
    h AS (SELECT page_id, line, CASE WHEN {d.has('content', '^h[1-6]')} THEN CAST({d.find('content', '^h([1-6])', 1)} AS INT) ELSE 0 END AS level, {d.find('content', '^h[1-6][^>]*>(.*)', 1)} AS heading FROM l)
    SELECT page_id, line, coalesce({level(1)}, '') || ' / ' || coalesce({level(2)}, '') AS path FROM h"""


@book.both("")
def perimeter_cells(d):
    """Cells of each supplier's balance sheet between neighbouring row and column edges, with the order lines (by discount and tax) in each and whether it is empty."""
    return f"""
    WITH e AS (SELECT DISTINCT l_suppkey, floor({d.d('l_discount')} * 50) AS y FROM {d.t('lineitem')}), r AS (SELECT l_suppkey, y, lead(y) OVER (PARTITION BY l_suppkey ORDER BY y) AS y1, row_number() OVER (PARTITION BY l_suppkey ORDER BY y) AS i FROM e),
    f AS (SELECT DISTINCT l_suppkey, floor({d.d('l_quantity')} / 10) AS x FROM {d.t('lineitem')}), k AS (SELECT l_suppkey, x, lead(x) OVER (PARTITION BY l_suppkey ORDER BY x) AS x1, row_number() OVER (PARTITION BY l_suppkey ORDER BY x) AS j FROM f),
    p AS (SELECT l_suppkey, floor({d.d('l_discount')} * 50) AS py, floor({d.d('l_quantity')} / 10) AS px, count(*) AS n FROM {d.t('lineitem')} GROUP BY l_suppkey, floor({d.d('l_discount')} * 50), floor({d.d('l_quantity')} / 10))
    SELECT r.l_suppkey, {d.i('i')} AS i, {d.i('j')} AS j, {d.i('coalesce(sum(p.n), 0)')} AS atoms, coalesce(sum(p.n), 0) = 0 AS empty FROM r JOIN k ON r.l_suppkey = k.l_suppkey AND r.y1 IS NOT NULL AND k.x1 IS NOT NULL
    LEFT JOIN p ON p.l_suppkey = r.l_suppkey AND px >= x AND px < x1 AND py >= y AND py < y1 GROUP BY r.l_suppkey, i, j"""


@book.both("TBL4 SUB70 SUB80")
def claim_to_table(d):
    """Which table-like document holds a claimed cell (each cell of such a document is claimed): bound to one, or ambiguous."""
    cells = d.places('doc_id', d.split('text', ' [|] '), f"(SELECT doc_id, text FROM {d.t('documents')} WHERE text LIKE '%|%') t", 'k', 'cell')
    return f"""
    WITH c AS (SELECT DISTINCT doc_id, trim(cell) AS cell FROM ({cells}) x),
    n AS (SELECT cell, count(*) AS n, min(doc_id) AS first_doc FROM c GROUP BY cell)
    SELECT c.doc_id AS claim_of, c.cell, n, first_doc, CASE n WHEN 1 THEN 'BOUND' ELSE 'AMBIGUOUS' END AS state FROM c JOIN n ON c.cell = n.cell"""


BUNDLE = """
WITH m AS (SELECT 'doc' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '/../x' ELSE '.txt' END AS name, doc_id, length(text) AS size FROM documents),
s AS (SELECT name, doc_id, size, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM m WHERE NOT contains(name, '..'))
SELECT doc_id, name, size, upto <= 200000 AS fits FROM s"""


@book.frame("SRC3", BUNDLE)
def bundle_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Members of a bundle that pass its rules (a listed name, no path upwards) while the running size stays in bounds; the sum runs block by block."""
    docs = spread(table(spark, folder, "documents"))
    name = F.concat(F.lit("doc"), "doc_id", F.when(F.col("doc_id") % 7 == 0, "/../x").otherwise(".txt"))
    members = docs.select(F.lit(0).alias("bundle"), "doc_id", name.alias("name"), F.length("text").cast("long").alias("size")).where(~F.contains("name", F.lit("..")))
    upto = running(blocked(members, ["bundle"], ["doc_id"]), ["bundle"], ["doc_id"], total={"upto": F.col("size")})
    return upto.select("doc_id", "name", "size", (F.col("upto") <= 200_000).alias("fits"))
