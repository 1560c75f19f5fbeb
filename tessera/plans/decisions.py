"""Scopes, identities, requirements, claims and the answer-or-abstain ladder.

The test tables have no sentences of technical language, so chunks are spelled out of
``part``: five parts make a manual of one model, and each part gives a sentence with its
own size, price and type as the values. Every 50th part asks a question. Candidates of a
question are found by the names it asks for or its two rarest tokens, never by pairing all questions with all chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import candidates
from tessera.plans.dialect import Book, Spark
from tessera.session import settled
from tessera.sources.tables import table

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS

#: Models and fault codes as they are written in chunks and questions.
NAME = "[A-Z]{2}-?[0-9]{2,9}|[EF][0-9]{2,9}"
SERIES = "CASE k % 6 WHEN 0 THEN 'EC' WHEN 1 THEN 'ST' WHEN 2 THEN 'PR' WHEN 3 THEN 'LA' WHEN 4 THEN 'ME' ELSE 'SM' END"


def chunks(d):
    """chunk_id, doc, model ('' for general notes), series, family, page and text of each part."""
    n = lambda x: f"CAST({x} AS VARCHAR(20))"
    price = n("CAST(floor(p_retailprice) AS BIGINT)")
    return f"""(SELECT chunk_id, 'd' || {n('k')} AS doc, model, CASE WHEN model = '' THEN '' ELSE series END AS series, family, page,
      CASE WHEN model = '' THEN 'General safety notes for a ' || name || '. Wear gloves of size ' || {n('size')} || '.'
           WHEN page = 1 THEN 'The ' || model || ' ' || name || ' supports ' || bus || ' at ' || {n('size * 100')} || ' baud. Parameter P' || {n('size')} || ' sets the ramp time to ' || {n('size')} || ' s.'
           WHEN page = 2 THEN 'Fault E' || {n('k + 10')} || ' means over-temperature. Let the ' || name || ' cool and check the fan.'
           WHEN page = 3 THEN 'The ' || model || ' ' || name || ' supports ' || bus || '. Rated voltage ' || {price} || ' V. Firmware 2.' || {n('size')} || ' or later.'
           WHEN page = 4 THEN name || ' ' || model || ' has a rated torque of ' || {n('size')} || ' Nm and weighs ' || {price} || ' kg. Rated voltage ' || {n('size * 8')} || ' V.'
           ELSE 'Do not open the cover of the ' || model || '. Fault E' || {n('k + 10')} || ' does not apply to a ' || name || '.' END AS text
      FROM (SELECT chunk_id, k, page, name, size, p_retailprice, family, {SERIES} AS series, CASE WHEN k % 7 = 6 THEN '' ELSE {SERIES} || '-' || {n('k + 10')} END AS model, CASE WHEN size % 2 = 0 THEN 'Modbus RTU' ELSE 'CANopen' END AS bus
            FROM (SELECT p_partkey AS chunk_id, CAST(floor(p_partkey / 5) AS BIGINT) AS k, p_partkey % 5 + 1 AS page, p_name AS name, CAST(p_size AS BIGINT) AS size, p_retailprice, lower(p_type) AS family FROM {d.t('part')}) k0) k1)"""


def asks(d):
    """ask, question, model and code for every 50th part: its own manual, one that no chunk has, or none."""
    n = lambda x: f"CAST({x} AS VARCHAR(20))"
    own = f"{SERIES} || '-' || {n('k + 10')}"
    return f"""(SELECT ask, model, code,
      CASE kind WHEN 0 THEN 'What does fault ' || code || ' mean on the ' || model || '?' WHEN 1 THEN 'Which bus does the ' || model || ' support?'
           WHEN 2 THEN 'What is the rated torque of the ' || model || '?' WHEN 3 THEN 'Ramp time of the ' || model WHEN 4 THEN 'What does fault ' || code || ' mean?'
           WHEN 5 THEN 'Should I wear gloves with a ' || name || '?' WHEN 6 THEN 'How do I bypass the password of the drive?' ELSE 'Is the rated voltage of the ' || model || ' 400 V?' END AS question
      FROM (SELECT ask, name, kind, CASE WHEN kind IN (4, 5, 6) THEN '' WHEN kind = 3 THEN 'CX-' || {n('k + 10')} ELSE {own} END AS model,
                   CASE kind WHEN 0 THEN 'E' || {n('k + 10')} WHEN 4 THEN 'F' || {n('k + 10')} ELSE '' END AS code
            FROM (SELECT p_partkey AS ask, CAST(floor(p_partkey / 5) AS BIGINT) AS k, p_partkey % 5 + 1 AS page, p_name AS name, CAST(floor(p_partkey / 50) AS BIGINT) % 8 AS kind FROM {d.t('part')} WHERE p_partkey % 50 = 0) a0) a1)"""


TABLES = lambda d: f"c AS (SELECT * FROM {chunks(d)} c9), a AS (SELECT * FROM {asks(d)} a9)"
#: hits: tokens in common of a question and its candidates: chunks with one of the names (tokens with digits) that it asks
#: for, or, where it asks for none, with both of its two rarest tokens.
SCORED = lambda d: f"""qt AS (SELECT ask, token, CASE WHEN {d.has('token', '[0-9]')} THEN 1 ELSE 0 END AS is_name FROM (SELECT ask, {d.explode(d.distinct(d.tokens('question')))} AS token FROM a) q0 WHERE length(token) > 2),
    ct AS (SELECT chunk_id, token FROM (SELECT chunk_id, {d.explode(d.distinct(d.tokens('text')))} AS token FROM c) c0 WHERE token IN (SELECT token FROM qt)),
    df AS (SELECT token, count(*) AS df FROM ct GROUP BY token),
    rare AS (SELECT ask, token, named FROM (SELECT qt.ask, qt.token, is_name, max(is_name) OVER (PARTITION BY qt.ask) AS named, row_number() OVER (PARTITION BY qt.ask ORDER BY CASE WHEN df.df IS NULL THEN 1 ELSE 0 END, df.df, qt.token) AS k
             FROM qt LEFT JOIN df ON qt.token = df.token) r0 WHERE named = 1 AND is_name = 1 OR named = 0 AND k <= 2),
    cand AS (SELECT rare.ask, ct.chunk_id FROM rare JOIN ct ON rare.token = ct.token GROUP BY rare.ask, ct.chunk_id HAVING max(named) = 1 OR count(*) = 2),
    hits AS (SELECT cand.ask, cand.chunk_id, count(*) AS n FROM cand JOIN qt ON cand.ask = qt.ask JOIN ct ON cand.chunk_id = ct.chunk_id AND qt.token = ct.token GROUP BY cand.ask, cand.chunk_id)"""  # noqa: E731
#: names: the models and codes that each chunk has, in its text or as its model.
NAMES = lambda d: f"""names AS (SELECT DISTINCT chunk_id, doc, name FROM (SELECT chunk_id, doc, {d.explode(d.find_all('text', NAME))} AS name FROM c UNION ALL SELECT chunk_id, doc, model FROM c WHERE model <> '') n0)"""



def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """``chunks`` with their distinct tokens."""
    d = Spark(spark, folder)
    return spark.sql(f"SELECT *, {d.distinct(d.tokens('text'))} AS tokens FROM {chunks(d)} c9")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct questions of ``asks``: ask (the first that asks it), asks (all), question, model, code and distinct tokens of more than two characters."""
    d = Spark(spark, folder)
    one = spark.sql(f"SELECT question, model, code, array_sort(collect_list(ask)) AS asks FROM {asks(d)} a9 GROUP BY question, model, code")
    tokens = f"filter({d.distinct(d.tokens('question'))}, t_ -> length(t_) > 2) AS tokens"
    return settled(one.selectExpr("asks[0] AS ask", "asks", "question", "model", "code", tokens))


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """What SCORED's hits JOIN a JOIN c gives, for each distinct question once; a.asks has all that ask it."""
    return candidates.hits(_chunks(spark, folder), _questions(spark, folder))


def each(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` of distinct questions (with asks) for all that ask them."""
    return rows.select(F.explode("asks").alias("ask"), *columns)


@book.both("FLT1 FLT2 FLT3 SUB60")
def exact_filter_with_fallback(d):
    """Every 50th part asks for its brand and the type of the part before it: the parts that have both, or all of the brand where none has; a filter that never empties."""
    return f"""
    WITH q AS (SELECT a.p_partkey AS ask, lower(a.p_brand) AS brand, lower(b.p_type) AS kind FROM {d.t('part')} a JOIN {d.t('part')} b ON b.p_partkey = a.p_partkey - 1 WHERE a.p_partkey % 50 = 0),
    both_ AS (SELECT lower(p_brand) AS brand, lower(p_type) AS kind, count(*) AS n, min(p_partkey) AS first_part FROM {d.t('part')} GROUP BY lower(p_brand), lower(p_type)),
    one AS (SELECT brand, {d.i('sum(n)')} AS n, min(first_part) AS first_part FROM both_ GROUP BY brand)
    SELECT ask, coalesce(b.n, o.n) AS parts, coalesce(b.first_part, o.first_part) AS first_part, coalesce(b.n, 0) AS exact FROM q JOIN one o ON o.brand = q.brand LEFT JOIN both_ b ON b.brand = q.brand AND b.kind = q.kind"""


@book.both("FLT4 SUB4 HAR35")
def identifier_scope(d):
    """Chunks that have every identifier of a question, in their text or as their model."""
    return f"""
    WITH {TABLES(d)}, {NAMES(d)}, w AS (SELECT ask, {d.explode(d.distinct(d.find_all('question', NAME)))} AS name FROM a), need AS (SELECT ask, count(*) AS k FROM w GROUP BY ask)
    SELECT w.ask, names.chunk_id FROM w JOIN names ON w.name = names.name JOIN need ON w.ask = need.ask GROUP BY w.ask, names.chunk_id, k HAVING count(*) = k"""


@book.both("JOIN3 IDN5")
def identity_relation_matrix(d):
    """How many chunks have each relation to a question's model, from the same model to a mismatch: counts by model and series, no pairs."""
    series = d.find('a.model', '^[A-Z]+')
    return f"""
    WITH {TABLES(d)}, m AS (SELECT model, count(*) AS n FROM c WHERE model <> '' GROUP BY model), s AS (SELECT series, count(*) AS n FROM c WHERE model <> '' GROUP BY series),
    t AS (SELECT count(*) AS n, {d.i("sum(CASE WHEN model = '' THEN 1 ELSE 0 END)")} AS blank FROM c),
    r AS (SELECT a.ask, a.model, t.n AS every, t.blank, coalesce(m.n, 0) AS same, coalesce(s.n, 0) AS series FROM a JOIN t ON true LEFT JOIN m ON a.model = m.model LEFT JOIN s ON {series} = s.series),
    x AS (SELECT ask, 'UNKNOWN' AS relation, CASE WHEN model = '' THEN every ELSE blank END AS chunks FROM r UNION ALL SELECT ask, 'EXACT_MODEL', same FROM r WHERE model <> ''
      UNION ALL SELECT ask, 'SAME_SERIES', series - same FROM r WHERE model <> '' UNION ALL SELECT ask, 'MISMATCH', every - blank - series FROM r WHERE model <> '')
    SELECT ask, relation, chunks, relation IN ('UNKNOWN', 'EXACT_MODEL') AS compatible FROM x WHERE chunks > 0"""


@book.both("JOIN5 WIN4 RET7")
def scope_tier_fill(d):
    """Ten parts for each asked part, filled tier by tier (brand and type, brand, size); a part fills once, in its first tier."""
    return f"""
    WITH q AS (SELECT p_partkey AS ask, p_brand AS b, p_type AS t, p_size AS s FROM {d.t('part')} WHERE p_partkey % 50 = 0),
    m AS (SELECT ask, p_partkey, CASE WHEN p_brand = b AND p_type = t THEN 0 WHEN p_brand = b THEN 1 ELSE 2 END AS tier FROM q JOIN {d.t('part')} p ON (p_brand = b) AND p_partkey <> ask
          UNION ALL SELECT ask, p_partkey, 2 AS tier FROM q JOIN {d.t('part')} p ON p_size = s AND p_brand <> b),
    r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY tier, p_partkey) AS rank FROM m)
    SELECT ask, p_partkey, {d.i('tier')} AS tier, {d.i('rank')} AS rank FROM r WHERE rank <= 10"""


#: Parts that fill an asked one, and keys of a group that hold as many besides the asked one's own.
FILL, HELD = 10, 11


def _least(parts: DataFrame, group: str, kind: str) -> DataFrame:
    """The rows of each ``group`` that hold its least HELD keys without any one ``kind``, whichever is left out.

    Of each kind the least HELD keys are taken, and of those together the least 2 * HELD: no more than HELD are of one kind.
    """
    first = parts.withColumn("k", F.dense_rank().over(W.partitionBy(group, kind).orderBy("p_partkey"))).where(F.col("k") <= HELD)
    return first.withColumn("k", F.dense_rank().over(W.partitionBy(group).orderBy("p_partkey"))).where(F.col("k") <= 2 * HELD).drop("k")


@book.runs(scope_tier_fill)
def _(spark: SparkSession, folder: str) -> DataFrame:
    # A part fills from the least keys of its tiers' groups, so no asked part meets a whole brand or size.
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size").where("p_partkey IS NOT NULL")
    q = parts.where("p_partkey % 50 = 0").selectExpr("p_partkey AS ask", "p_brand AS b", "p_type AS t", "p_size AS s")
    both = parts.withColumn("k", F.dense_rank().over(W.partitionBy("p_brand", "p_type").orderBy("p_partkey"))).where(F.col("k") <= HELD)
    tiers = [(both, "p_brand = b AND p_type = t"), (_least(parts, "p_brand", "p_type"), "p_brand = b AND NOT coalesce(p_type = t, false)"), (_least(parts, "p_size", "p_brand"), "p_size = s AND p_brand <> b")]
    met = [q.join(rows.hint("merge"), F.expr(f"{on} AND p_partkey <> ask")).select("ask", "p_partkey", F.lit(i).cast("long").alias("tier")) for i, (rows, on) in enumerate(tiers)]
    rank = F.row_number().over(W.partitionBy("ask").orderBy("tier", "p_partkey")).cast("long")
    return met[0].union(met[1]).union(met[2]).withColumn("rank", rank).where(F.col("rank") <= FILL)


@book.both("IDN1 IDN2 IDN3 IDN13 SUB1 FLT15")
def query_identities(d):
    """Models that a question names, raw and without hyphens, against those of the corpus; which of them the corpus lacks."""
    return f"""
    WITH {TABLES(d)}, m AS (SELECT ask, {d.explode(d.distinct(d.find_all('question', '[A-Z]{2}-?[0-9]{2,9}')))} AS model FROM a),
    k AS (SELECT DISTINCT replace(model, '-', '') AS folded FROM c WHERE model <> '')
    SELECT ask, m.model, k.folded IS NOT NULL AS known, CASE WHEN k.folded IS NOT NULL THEN 'EXACT' ELSE 'UNKNOWN' END AS confidence FROM m LEFT JOIN k ON replace(m.model, '-', '') = k.folded"""


@book.both("IDN6 IDN7 SUB57 SUB58 SUB59 IDN8 JOIN20")
def extended_identity(d):
    """Firmware, parameter, protocol and voltage of each chunk, and whether its firmware is at least 2.9 by numbers, not by text."""
    return f"""
    WITH {TABLES(d)}, e AS (SELECT chunk_id, {d.find('text', '[Ff]irmware ([0-9.]+[0-9])', 1)} AS firmware, {d.find('text', 'Parameter (P[0-9]+)', 1)} AS parameter,
           {d.find('text', '(Modbus RTU|CANopen)', 1)} AS protocol, {d.has('text', 'or later')} AS is_floor FROM c)
    SELECT *, CASE WHEN firmware = '' THEN 'unknown' WHEN CAST({d.find('firmware', '^([0-9]+)', 1)} AS INT) * 1000 + CAST({d.find('firmware', '[.]([0-9]+)', 1)} AS INT) >= 2009 THEN 'yes' ELSE 'no' END AS at_least_2_9 FROM e"""


@book.both("FLT11 FLT13 FLT16 SUB56")
def coverage_gate(d):
    """A verdict for each question: the models and codes it names that no chunk has, in order, as the reason."""
    return f"""
    WITH {TABLES(d)}, {NAMES(d)}, n AS (SELECT ask, {d.explode(d.distinct(d.find_all('question', NAME)))} AS name FROM a),
    missing AS (SELECT n.ask, n.name FROM n LEFT JOIN (SELECT DISTINCT name FROM names) k ON n.name = k.name WHERE k.name IS NULL)
    SELECT a.ask, m.reason IS NULL AS ok, coalesce(m.reason, '') AS reason FROM a LEFT JOIN (SELECT ask, {d.listed('name', '+', 'name')} AS reason FROM missing GROUP BY ask) m ON a.ask = m.ask"""


@book.both("EVD2 EVD4 EVD5 SUB8")
def typed_requirements(d):
    """What each question needs, as typed items: an identifier, a model, a value with its attribute, or keywords."""
    return f"""
    WITH {TABLES(d)}
    SELECT ask, 'identifier' AS kind, code AS item, true AS critical FROM a WHERE code <> ''
    UNION ALL SELECT ask, 'model', model, true FROM a WHERE model <> ''
    UNION ALL SELECT ask, 'attribute', {d.find('lower(question)', '(rated torque|ramp time|rated voltage|bus)', 1)}, true FROM a WHERE {d.has('lower(question)', '(rated torque|ramp time|rated voltage|bus)')}
    UNION ALL SELECT ask, 'keyword', {d.explode(d.distinct(d.find_all('lower(question)', '[a-z]{6,}')))}, false FROM a"""


@book.both("JOIN8 EVD6 EVD9 AGG40 SET6")
def claim_cover_pairs(d):
    """Groups of one or two chunks of a document that together hold all critical items of a question."""
    return f"""
    WITH {TABLES(d)}, {NAMES(d)}, r AS (SELECT ask, code AS item FROM a WHERE code <> '' UNION ALL SELECT ask, model FROM a WHERE model <> ''),
    need AS (SELECT ask, count(*) AS k FROM r GROUP BY ask),
    has_item AS (SELECT r.ask, r.item, names.chunk_id, names.doc FROM r JOIN names ON names.name = r.item),
    pair AS (SELECT x.ask, x.chunk_id AS a, y.chunk_id AS b, x.item AS i, y.item AS j FROM has_item x JOIN has_item y ON x.ask = y.ask AND x.doc = y.doc AND x.chunk_id <= y.chunk_id)
    SELECT pair.ask, a, b FROM (SELECT ask, a, b, i AS item FROM pair UNION SELECT ask, a, b, j FROM pair) pair JOIN need ON pair.ask = need.ask GROUP BY pair.ask, a, b, k HAVING count(DISTINCT item) = k"""


@book.both("JOIN9 SUB13 SUB14 EVD7")
def local_value_scope(d):
    """Documents whose pages with a value are at most two pages apart, so that their values may be read together."""
    return f"""
    WITH {TABLES(d)}, v AS (SELECT doc, model, page FROM c WHERE {d.has('text', '[0-9]+(?:[.][0-9]+)? (?:V|Nm|kg|s|baud)')})
    SELECT doc, model, count(*) AS pages, max(page) - min(page) AS spread, max(page) - min(page) <= 2 AS same_scope FROM v GROUP BY doc, model"""


REASON = """CASE WHEN unsafe THEN 'SECURITY_BYPASS' WHEN asks_code AND NOT code_known THEN 'UNKNOWN_IDENTIFIER' WHEN asks_model AND NOT model_known THEN 'MODEL_MISMATCH'
           WHEN best IS NULL THEN 'NO_CANDIDATE' WHEN asks_model AND own = 0 THEN 'NO_COMPATIBLE' WHEN asks_code THEN 'IDENTIFIER_MATCH' WHEN asks_model THEN 'MODEL_MATCH'
           WHEN best >= 2 THEN 'LEXICAL_MATCH' ELSE 'WEAK_EVIDENCE' END"""
#: reasons: the first branch that holds for each question.
LADDER = lambda d: f"""{TABLES(d)}, {SCORED(d)}, {NAMES(d)}, known AS (SELECT DISTINCT name FROM names), models AS (SELECT DISTINCT model FROM c WHERE model <> ''),
    f AS (SELECT a.ask, a.code <> '' AS asks_code, a.model <> '' AS asks_model, {d.has('lower(question)', 'bypass')} AND {d.has('lower(question)', 'password')} AS unsafe, known.name IS NOT NULL AS code_known, models.model IS NOT NULL AS model_known
          FROM a LEFT JOIN known ON a.code = known.name LEFT JOIN models ON a.model = models.model),
    h AS (SELECT hits.ask, max(n) AS best, max(CASE WHEN c.model = a.model THEN n ELSE 0 END) AS own FROM hits JOIN c ON hits.chunk_id = c.chunk_id JOIN a ON hits.ask = a.ask GROUP BY hits.ask),
    reasons AS (SELECT f.ask, {REASON} AS reason FROM f LEFT JOIN h ON f.ask = h.ask)"""  # noqa: E731


DECISION = "CASE WHEN reason IN ('IDENTIFIER_MATCH', 'MODEL_MATCH', 'LEXICAL_MATCH') THEN 'ANSWER' ELSE 'ABSTAIN' END"


def _reasons(spark: SparkSession, folder: str) -> DataFrame:
    """LADDER's reasons for each distinct question: asks and reason."""
    d = Spark(spark, folder)
    every, asked = _chunks(spark, folder), _questions(spark, folder)
    wanted = lambda c: settled(asked.where(f"{c} <> ''").select(F.col(c).alias("name")).distinct())
    names = every.selectExpr(f"explode_outer({d.find_all('text', NAME)}) AS name").union(every.where("model <> ''").select("model"))
    known = candidates.met(names, wanted("code"), ["name"], "left_semi").distinct().select(F.col("name").alias("code"), F.lit(True).alias("code_known"))
    models = candidates.met(every.select(F.col("model").alias("name")), wanted("model"), ["name"], "left_semi").distinct().select(F.col("name").alias("model"), F.lit(True).alias("model_known"))
    h = candidates.hits(every, asked).groupBy("a.ask").agg(F.max("n").alias("best"), F.expr("max(CASE WHEN c.model = a.model THEN n ELSE 0 END)").alias("own"))
    unsafe = f"{d.has('lower(question)', 'bypass')} AND {d.has('lower(question)', 'password')} AS unsafe"
    f = asked.join(known.hint("merge"), "code", "left").join(models.hint("merge"), "model", "left").selectExpr(
        "ask", "asks", "code <> '' AS asks_code", "model <> '' AS asks_model", unsafe, "code_known IS NOT NULL AS code_known", "model_known IS NOT NULL AS model_known"
    )
    return f.join(h.hint("merge"), "ask", "left").selectExpr("asks", f"{REASON} AS reason")


@book.both("EVD1 SUB2 EVD17 EVD18 FLT14")
def evidence_ladder(d):
    """ANSWER or ABSTAIN for each question by the first branch that holds, with the reason."""
    return f"""
    WITH {LADDER(d)}
    SELECT ask, {DECISION} AS decision, reason FROM reasons"""


@book.runs(evidence_ladder)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return each(_reasons(spark, folder).selectExpr("asks", f"{DECISION} AS decision", "reason"), ["decision", "reason"])


NAMED = "(CASE attribute WHEN 'bus' THEN contains(text, 'Modbus') OR contains(text, 'CANopen') ELSE contains(lower(text), attribute) END)"
STATE = "CASE WHEN own AND unit AND named THEN 'SUPPORTED' WHEN unit AND named OR own AND named THEN 'PARTIAL' ELSE 'UNSUPPORTED' END"


def _attribute(d) -> str:
    return d.find("lower(question)", "(rated torque|ramp time|rated voltage|bus)", 1)


def _unit(d) -> str:
    units = {"rated torque": "[0-9] Nm", "ramp time": "[0-9] s[.]", "rated voltage": "[0-9] V", "bus": "supports"}
    return "CASE attribute " + " ".join(f"WHEN '{k}' THEN {d.has('text', p)}" for k, p in units.items()) + " ELSE false END"


@book.both("EVD10 EVD11 EVD12 EVD14 SUB6 SUB11 SUB12")
def support_gate(d):
    """Whether a candidate chunk supports a question's attribute with a value of a fitting unit: supported, partial or unsupported."""
    return f"""
    WITH {TABLES(d)}, {SCORED(d)}, q AS (SELECT ask, {_attribute(d)} AS attribute, model FROM a),
    j AS (SELECT q.ask, c.chunk_id, {NAMED} AS named, {_unit(d)} AS unit, c.model = q.model AS own FROM q JOIN hits ON q.ask = hits.ask JOIN c ON hits.chunk_id = c.chunk_id WHERE q.attribute <> '')
    SELECT ask, chunk_id, {STATE} AS state FROM j"""


@book.runs(support_gate)
def _(spark: SparkSession, folder: str) -> DataFrame:
    d = Spark(spark, folder)
    found = hits(spark, folder).selectExpr("a.asks", "a.question", "c.chunk_id", "c.text", "c.model = a.model AS own")
    j = found.selectExpr("*", f"{_attribute(d)} AS attribute").where("attribute <> ''")
    return each(j.selectExpr("asks", "chunk_id", "own", f"{NAMED} AS named", f"{_unit(d)} AS unit").selectExpr("asks", "chunk_id", f"{STATE} AS state"), ["chunk_id", "state"])


@book.both("EVD8 EVD15 SUB54")
def proximity_support(d):
    """How far the nearest number is from the word 'rated' or 'firmware' in a chunk; near is within 60 characters."""
    return f"""
    WITH {TABLES(d)}, p AS (SELECT chunk_id, {d.i("instr(lower(text), 'rated')")} AS rated, {d.i("instr(lower(text), 'firmware')")} AS firmware, {d.find('text', '(?:[Rr]ated|[Ff]irmware)[^0-9]{0,60}[0-9]')} AS gap FROM c)
    SELECT chunk_id, greatest(rated, firmware) AS anchor, gap <> '' AS near, {d.length('gap')} AS distance FROM p WHERE rated > 0 OR firmware > 0"""


FAMILY = "CASE WHEN reason LIKE '%IDENTIFIER%' OR reason LIKE '%MODEL%' THEN 'IDENTIFIER_MATCH' WHEN substr(reason, 1, 3) = 'NO_' THEN 'NO_EVIDENCE' WHEN reason LIKE '%MISMATCH%' THEN 'MISMATCH' ELSE 'OTHER' END"


@book.both("EVL2")
def evidence_reason_hist(d):
    """The ladder's reasons mapped to families by the order of the tests: the first substring wins, so two families hide later ones."""
    return f"""
    WITH {LADDER(d)},
    families AS (SELECT reason, {FAMILY} AS family FROM reasons)
    SELECT family, count(*) AS n, count(DISTINCT reason) AS reasons, min(reason) AS first_reason FROM families GROUP BY family"""


@book.runs(evidence_reason_hist)
def _(spark: SparkSession, folder: str) -> DataFrame:
    counted = _reasons(spark, folder).groupBy("reason").agg(F.sum(F.size("asks").cast("long")).alias("n")).selectExpr("reason", "n", f"{FAMILY} AS family")
    return counted.groupBy("family").agg(F.sum("n").alias("n"), F.count("*").alias("reasons"), F.min("reason").alias("first_reason"))


@book.both("EXP1 EXP2 EXP12 EXP37 HAR40")
def query_routing(d):
    """The kind of question and its slot, by the first rule that matches."""
    return f"""
    WITH {TABLES(d)}
    SELECT ask, CASE WHEN {d.has('lower(question)', '^(?:is|are|does|do|should|can) ')} THEN 'VERIFICATION' WHEN {d.has('lower(question)', '^(?:what|which|how|when|where) ')} THEN 'EXTRACTION' ELSE 'UNKNOWN' END AS route,
           CASE WHEN {d.has('lower(question)', 'fault')} THEN 'fault_meaning' WHEN {d.has('lower(question)', 'torque|voltage|time')} THEN 'value' WHEN {d.has('lower(question)', 'bus')} THEN 'protocol' ELSE 'none' END AS slot FROM a"""


def _relation(d) -> str:
    return f"""CASE WHEN a.model <> '' AND c.model = a.model THEN 'DIRECT' WHEN a.model <> '' AND contains(c.text, a.model) THEN 'REFERENCED'
           WHEN a.model <> '' AND c.series = {d.find('a.model', '^[A-Z]+')} THEN 'INHERITED' WHEN a.model = '' THEN 'DEPENDENT' ELSE 'UNSUPPORTED' END"""


@book.both("EXP22 EXP24 EXP26 EXP33")
def typed_coverage_relation(d):
    """How a chunk covers a question: its own model directly, by reference, by its series, or not."""
    return f"""
    WITH {TABLES(d)}, {SCORED(d)}
    SELECT hits.ask, hits.chunk_id, {_relation(d)} AS relation, n
    FROM hits JOIN a ON hits.ask = a.ask JOIN c ON hits.chunk_id = c.chunk_id"""


@book.runs(typed_coverage_relation)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return each(hits(spark, folder).selectExpr("a.asks", "c.chunk_id", f"{_relation(Spark(spark, folder))} AS relation", "n"), ["chunk_id", "relation", "n"])


@book.both("EXP28 SUB48")
def competing_values(d):
    """Pairs of chunks of one document that give one unit different values: candidates for a conflict."""
    p = "[0-9]+(?:[.][0-9]+)? (?:V|Nm|kg|baud)"
    return f"""
    WITH {TABLES(d)}, s AS (SELECT doc, chunk_id, {d.explode(d.distinct(d.find_all('text', p)))} AS spec FROM c), v AS (SELECT doc, chunk_id, {d.find('spec', '^([0-9.]+)', 1)} AS value, {d.find('spec', ' (.+)$', 1)} AS unit FROM s)
    SELECT x.chunk_id AS a, y.chunk_id AS b, x.unit, x.value AS value_a, y.value AS value_b FROM v x JOIN v y ON x.doc = y.doc AND x.unit = y.unit AND x.chunk_id < y.chunk_id AND x.value <> y.value"""


@book.both("EXP41 EXP4 SUB18 SUB19 SUB20")
def spec_extraction(d):
    """Every number with its unit in the chunks, with where it stands."""
    return f"""
    WITH {TABLES(d)}, p AS ({d.places('chunk_id', d.find_all('text', '[0-9]+(?:[.][0-9]+)? (?:V|Nm|kg|baud|s)'), 'c', 'k', 'spec')})
    SELECT chunk_id, k, spec, {d.d(d.find('spec', '^([0-9.]+)', 1))} AS value, {d.find('spec', ' (.+)$', 1)} AS unit FROM p"""


@book.both("EXP7 EXP8 EXP9 SUB27")
def span_multiplicity(d):
    """Whether the chunks that have a question's code are none, one or several."""
    return f"""
    WITH {TABLES(d)}, {NAMES(d)}, s AS (SELECT a.ask, count(names.chunk_id) AS n FROM a LEFT JOIN names ON a.code = names.name GROUP BY a.ask)
    SELECT ask, n, CASE WHEN n = 0 THEN 'NONE' WHEN n = 1 THEN 'UNIQUE' ELSE 'MULTIPLE' END AS multiplicity, n = 1 AS sufficient FROM s"""


@book.both("EXP10 EXP11 SUB30 RET14")
def answer_context(d):
    """The context of each question: its chunks by overlap where it has two hits or more, empty otherwise."""
    return f"""
    WITH {TABLES(d)}, {SCORED(d)}
    SELECT a.ask, coalesce(h.n, 0) AS chunks, coalesce(h.ids, '') AS citations FROM a
    LEFT JOIN (SELECT ask, count(*) AS n, {d.listed('CAST(chunk_id AS VARCHAR(10))', ',', 'n DESC, chunk_id')} AS ids FROM hits WHERE n >= 2 GROUP BY ask) h ON a.ask = h.ask"""


@book.runs(answer_context)
def _(spark: SparkSession, folder: str) -> DataFrame:
    d = Spark(spark, folder)
    asked = _questions(spark, folder)
    found = candidates.hits(_chunks(spark, folder), asked).where("n >= 2").selectExpr("a.ask", "c.chunk_id", "n")
    h = found.groupBy("ask").agg(F.count("*").alias("chunks"), F.expr(d.listed("CAST(chunk_id AS VARCHAR(10))", ",", "n DESC, chunk_id")).alias("citations"))
    return each(asked.join(h.hint("merge"), "ask", "left").na.fill({"chunks": 0, "citations": ""}).drop("ask"), ["chunks", "citations"])


@book.both("JOIN7 WIN23 RET8 TOP4")
def neighbor_expand(d):
    """Two neighbours on either side of each anchor document within its source, nearest first, the one before first; each once."""
    return f"""
    WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM {d.t('documents')}),
    x AS (SELECT doc_id AS anchor, source, pos FROM s WHERE doc_id % 50 = 0),
    n AS (SELECT x.anchor, s.doc_id, abs(s.pos - x.pos) AS dist, CASE WHEN s.pos < x.pos THEN 0 ELSE 1 END AS side FROM x JOIN s ON s.source = x.source AND s.pos BETWEEN x.pos - 2 AND x.pos + 2 AND s.pos <> x.pos),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dist, side, anchor) AS first_use FROM n)
    SELECT anchor, doc_id, {d.i('row_number() OVER (PARTITION BY anchor ORDER BY dist, side)')} AS place FROM o WHERE first_use = 1"""


@book.both("")
def region_siblings_budget(d):
    """Up to four siblings of each order's first line within a budget of 100 in quantity, in line order."""
    return f"""
    WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k,
                      sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS used FROM {d.t('lineitem')})
    SELECT l_orderkey, count(*) AS siblings, max(used) AS used FROM b WHERE k BETWEEN 2 AND 5 AND used <= 100 GROUP BY l_orderkey"""


@book.both("")
def gap_cluster_1d(d):
    """Prices of each supplier clustered where neighbours are more than 50 apart; the mean of each cluster."""
    return f"""
    WITH o AS (SELECT l_suppkey, l_extendedprice AS v, CASE WHEN l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) <= 50 THEN 0 ELSE 1 END AS starts FROM {d.t('lineitem')}),
    g AS (SELECT l_suppkey, v, sum(starts) OVER (PARTITION BY l_suppkey ORDER BY v ROWS UNBOUNDED PRECEDING) AS cluster FROM o)
    SELECT l_suppkey, {d.i('cluster')} AS cluster, count(*) AS n, min(v) AS low, max(v) AS high FROM g GROUP BY l_suppkey, cluster"""


@book.both("")
def proof_lineage(d):
    """Ids that name rows of different content: repeated order lines with more than one signature."""
    return f"""
    SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_partkey) AS signatures FROM {d.t('lineitem')} GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_partkey) > 1"""


@book.both("")
def edge_coverage(d):
    """How much of each order's span (its quantities end to end) its lines cover, each by a share of its own, and whether that is the 0.45 that a boundary needs."""
    return f"""
    WITH l AS (SELECT l_orderkey AS line, {d.d('l_quantity')} AS q, {d.d('l_quantity')} * (1 - 5 * {d.d('l_discount')}) AS own, sum({d.d('l_quantity')}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS upto FROM {d.t('lineitem')}),
    s AS (SELECT line, upto - q AS x0, upto - q + greatest(own, 0) AS x1, max(upto) OVER (PARTITION BY line) AS hi FROM l)
    SELECT line, round(sum(x1 - x0) / max(hi), 6) AS coverage, round(sum(x1 - x0) / max(hi), 6) >= 0.45 AS boundary FROM s GROUP BY line"""


@book.both("")
def cell_roles(d):
    """Columns of bar-separated lines by the share of cells with digits: labels, values or mixed."""
    return f"""
    WITH l AS ({d.places('doc_id', d.split('text', chr(10)), d.t('documents'), 'line', 'content')}),
    x AS ({d.places('doc_id, line', d.split('content', ' [|] '), "(SELECT * FROM l WHERE content LIKE '%|%') t", 'cell', 'value')})
    SELECT cell, count(*) AS n, {d.i(f"sum(CASE WHEN {d.has('value', '[0-9]')} THEN 1 ELSE 0 END)")} AS numeric, CASE WHEN sum(CASE WHEN {d.has('value', '[0-9]')} THEN 1 ELSE 0 END) * 2 > count(*) THEN 'value' ELSE 'label' END AS role FROM x GROUP BY cell"""


@book.both("")
def constraint_reasons(d):
    """Rows that break a rule, with all their reasons in order: null or empty texts, wrong lengths, unknown languages."""
    return f"""
    WITH r AS (SELECT doc_id, 'empty' AS reason FROM {d.t('documents')} WHERE coalesce(trim(text), '') = ''
      UNION ALL SELECT doc_id, 'length' FROM {d.t('documents')} WHERE n_chars <> length(text)
      UNION ALL SELECT doc_id, 'language' FROM {d.t('documents')} WHERE lang NOT IN ('en', 'de')
      UNION ALL SELECT doc_id, 'short' FROM {d.t('documents')} WHERE length(text) < 200)
    SELECT doc_id, {d.listed('reason', '+', 'reason')} AS reasons, count(*) AS n FROM r GROUP BY doc_id"""
