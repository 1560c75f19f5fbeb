"""Evaluation metrics, calibration, comparisons between runs, and checks.

``labels`` gives the expected decision (quality 1: answer), and a rule on the texts the
decision made, so that every rate is over real rows: a document of 100 words or more
whose first character is no capital letter run is answered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ranks import at_ranks
from tessera.plans.dialect import Book
from tessera.sources.tables import table

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS


def runs(d) -> str:
    """r: doc_id, lang, source, expected, score, decided of each labelled document."""
    n = d.size(d.find_all("text", "[A-Za-z]+"))
    caps = d.length(d.sub("text", "[^A-Z]", ""))
    return f"""r AS (SELECT x.doc_id, lang, source, quality = 1 AS expected, toxic, round({caps} / {d.d('greatest(length(text), 1)')}, 3) AS score, {n} AS n_words,
           {n} >= 60 AND {caps} * 4 < length(text) AS decided FROM {d.t('documents')} x JOIN {d.t('labels')} y ON x.doc_id = y.doc_id)"""


def share(d, a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE round({d.d(a)} / {b}, 6) END"


def count_if(d, x: str) -> str:
    return d.i(f"sum(CASE WHEN {x} THEN 1 ELSE 0 END)")


RATES = lambda d: f"""count(*) AS n, {d.d(share(d, count_if(d, 'expected = decided'), 'count(*)'))} AS accuracy,
    {d.d(share(d, count_if(d, 'decided AND NOT expected'), count_if(d, 'NOT expected')))} AS false_answers, {d.d(share(d, count_if(d, 'expected AND NOT decided'), count_if(d, 'expected')))} AS false_refusals"""  # noqa: E731


@book.both("AGG10 HAR13 HAR16")
def decision_metrics(d):
    """Accuracy, false answers and false refusals; a rate without rows is 0."""
    return f"WITH {runs(d)} SELECT {RATES(d)} FROM r"


@book.both("AGG8 AGG6 AGG11 HAR21")
def metrics_by_category(d):
    """The same rates over all, by language and by source, from one pass with grouping sets."""
    return f"""
    WITH {runs(d)} SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, {RATES(d)} FROM r GROUP BY GROUPING SETS ((), (lang), (source))"""


@book.both("AGG9 HAR28 HAR29 EVL9 EVL11 AGG41")
def failure_taxonomy(d):
    """Each failure's kind by the first rule that matches, and how many there are."""
    return f"""
    WITH {runs(d)} SELECT CASE WHEN expected = decided THEN 'NONE' WHEN decided AND toxic = 1 THEN 'UNSAFE_ANSWER' WHEN decided THEN 'FALSE_ANSWER' WHEN n_words < 60 THEN 'TOO_SHORT' ELSE 'FALSE_REFUSAL' END AS failure,
           count(*) AS n, min(doc_id) AS first_id FROM r GROUP BY 1"""


@book.both("AGG16 AGG17")
def weighted_corpus_mean(d):
    """Mean accuracy over languages weighted by rows, beside the unweighted one, and their gap."""
    return f"""
    WITH {runs(d)}, l AS (SELECT lang, count(*) AS n, avg({d.d('CASE WHEN expected = decided THEN 1 ELSE 0 END')}) AS a FROM r GROUP BY lang)
    SELECT round({d.d('sum(n * a) / sum(n)')}, 6) AS weighted, round({d.d('avg(a)')}, 6) AS plain, round({d.d('sum(n * a) / sum(n) - avg(a)')}, 6) AS gap FROM l"""


@book.both("AGG31 AGG32")
def threshold_calibration(d):
    """The score below which to answer with the best accuracy, over all distinct scores from one sorted pass; ties to the smallest."""
    return f"""
    WITH {runs(d)}, s AS (SELECT score, {count_if(d, 'expected')} AS pos, {count_if(d, 'NOT expected')} AS neg FROM r GROUP BY score),
    w AS (SELECT score, sum(pos) OVER (ORDER BY score) AS pos_below, sum(neg) OVER () - sum(neg) OVER (ORDER BY score) AS neg_above, sum(pos + neg) OVER () AS n FROM s)
    SELECT score, {d.i('pos_below + neg_above')} AS correct, round({d.d('pos_below + neg_above')} / n, 6) AS accuracy FROM (SELECT *, row_number() OVER (ORDER BY pos_below + neg_above DESC, score) AS k FROM w) x WHERE k = 1"""


@book.both("AGG33 EXP42 HAR12")
def risk_sweep(d):
    """Cost (ten for a false answer, one for a false refusal) at each of a grid of ceilings."""
    grid = ", ".join(f"({x})" for x in (0.02, 0.04, 0.06, 0.1, 0.3))
    return f"""
    WITH {runs(d)}, t AS (SELECT * FROM {d.rows('tau', *grid.split(', '))} t0)
    SELECT {d.d('tau')} AS tau, {d.i('sum(CASE WHEN score <= tau AND NOT expected THEN 10 WHEN score > tau AND expected THEN 1 ELSE 0 END)')} AS cost, {count_if(d, 'score <= tau')} AS answered FROM r JOIN t ON true GROUP BY tau"""


@book.both("AGG34 EVL10")
def counterfactual_transitions(d):
    """What a stricter policy would change, row by row: safe blocks, regressions, no effect, unsafe."""
    return f"""
    WITH {runs(d)} SELECT CASE WHEN decided AND score > 0.05 AND NOT expected THEN 'SAFE_BLOCK' WHEN decided AND score > 0.05 THEN 'REGRESSION' WHEN decided AND NOT expected THEN 'UNSAFE' ELSE 'NO_EFFECT' END AS transition, count(*) AS n
    FROM r GROUP BY 1"""


@book.both("AGG18 HAR22")
def failure_pivot(d):
    """A matrix of languages by failure kinds."""
    return f"""
    WITH {runs(d)} SELECT lang, {count_if(d, 'decided AND NOT expected')} AS false_answers, {count_if(d, 'expected AND NOT decided')} AS false_refusals, {count_if(d, 'decided AND toxic = 1')} AS unsafe, count(*) AS n FROM r GROUP BY lang"""


@book.both("HAR23 HAR14")
def metric_range(d):
    """Each metric's smallest, largest and range over the languages."""
    return f"""
    WITH {runs(d)}, l AS (SELECT lang, avg({d.d('CASE WHEN expected = decided THEN 1 ELSE 0 END')}) AS accuracy, avg({d.d('CASE WHEN decided THEN 1 ELSE 0 END')}) AS answered FROM r GROUP BY lang),
    u AS (SELECT 'accuracy' AS metric, {d.d('accuracy')} AS v FROM l UNION ALL SELECT 'answered', {d.d('answered')} FROM l)
    SELECT metric, round(min(v), 6) AS low, round(max(v), 6) AS high, round(max(v) - min(v), 6) AS spread FROM u GROUP BY metric"""


@book.both("HAR19 HAR17")
def overlapping_slices(d):
    """Rows in several slices at once, each slice with its rates."""
    return f"""
    WITH {runs(d)}, s AS (SELECT 'ALL' AS slice, expected, decided FROM r UNION ALL SELECT 'HIGH', expected, decided FROM r WHERE n_words >= 300
      UNION ALL SELECT 'HIGH+MEDIUM', expected, decided FROM r WHERE n_words >= 100 UNION ALL SELECT 'AMBIGUOUS', expected, decided FROM r WHERE score BETWEEN 0.03 AND 0.06)
    SELECT slice, {RATES(d)} FROM s GROUP BY slice"""


@book.both("HAR18")
def acceptance_gate(d):
    """Whether a stricter run (what the looser one answers with scores to 0.05 alone) is accepted: refusals up by five points at most, and false answers down by half or more."""
    return f"""
    WITH {runs(d)}, m AS (SELECT {count_if(d, 'expected AND NOT decided')} AS fr_a, {count_if(d, 'expected AND NOT (decided AND score <= 0.05)')} AS fr_b, {count_if(d, 'expected')} AS pos,
      {count_if(d, 'NOT expected AND decided')} AS fa_a, {count_if(d, 'NOT expected AND decided AND score <= 0.05')} AS fa_b FROM r)
    SELECT fr_a, fr_b, fa_a, fa_b, round({d.d('fr_b - fr_a')} / greatest(pos, 1), 6) AS rise, {d.d('fr_b - fr_a')} / greatest(pos, 1) <= 0.05 AND 2 * fa_b <= fa_a AS accepted FROM m"""


@book.both("HAR9 HAR10 HAR11")
def ratio_bands(d):
    """For each source: enough rows of both labels, and the answer ratio inside its band."""
    return f"""
    WITH {runs(d)} SELECT source, {count_if(d, 'expected')} AS pos, {count_if(d, 'NOT expected')} AS neg, {count_if(d, 'expected')} >= 12 AND {count_if(d, 'NOT expected')} >= 2 AS quota,
           {d.d(count_if(d, 'expected'))} / count(*) BETWEEN 0.4 AND 0.9 AS in_band FROM r GROUP BY source"""


@book.both("HAR24 HAR25 HAR20 EVL15")
def failure_delta(d):
    """Failures fixed, introduced and unchanged between two policies, from a full outer join."""
    return f"""
    WITH {runs(d)}, x AS (SELECT doc_id FROM r WHERE expected <> decided), y AS (SELECT doc_id FROM r WHERE expected <> (decided AND score <= 0.05))
    SELECT CASE WHEN y.doc_id IS NULL THEN 'fixed' WHEN x.doc_id IS NULL THEN 'introduced' ELSE 'unchanged' END AS change, count(*) AS n FROM x FULL JOIN y ON x.doc_id = y.doc_id GROUP BY 1"""


@book.both("JOIN13 EVL3 RET12")
def label_overlay(d):
    """Labels laid over all documents, three-valued where there is none; equal with nulls counted as equal."""
    return f"""
    SELECT x.lang, CASE WHEN y.quality IS NULL THEN 'unknown' WHEN y.quality = 1 THEN 'relevant' ELSE 'irrelevant' END AS relevance, count(*) AS n, {count_if(d, 'y.quality IS NOT DISTINCT FROM y.toxic')} AS same
    FROM {d.t('documents')} x LEFT JOIN {d.t('labels')} y ON x.doc_id = y.doc_id GROUP BY 1, 2"""


@book.both("JOIN14 AGG13 AGG36")
def before_after(d):
    """Wins and losses of one policy over another by language."""
    return f"""
    WITH {runs(d)} SELECT lang, {count_if(d, 'expected = (decided AND score <= 0.05) AND expected <> decided')} AS wins, {count_if(d, 'expected <> (decided AND score <= 0.05) AND expected = decided')} AS losses FROM r GROUP BY lang"""


@book.both("JOIN15 HAR8")
def corpus_disjointness(d):
    """Texts that are in more than one source, which must be disjoint, and how many sources share them."""
    return f"""
    SELECT {d.sha('text')} AS digest, count(DISTINCT source) AS sources, count(*) AS n FROM {d.t('documents')} GROUP BY {d.sha('text')} HAVING count(DISTINCT source) > 1"""


@book.both("")
def comparison_coverage(d):
    """Orders whose lines cover all of the asked flags among their first five lines, by priority."""
    return f"""
    WITH k AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS k FROM {d.t('lineitem')}),
    c AS (SELECT l_orderkey, count(DISTINCT CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag END) AS have FROM k WHERE k <= 5 GROUP BY l_orderkey)
    SELECT o_orderpriority, count(*) AS orders, {count_if(d, 'have = 2')} AS covered FROM c JOIN {d.t('orders')} o ON o.o_orderkey = c.l_orderkey GROUP BY o_orderpriority"""


@book.both("AGG19 EVL1")
def contract_verdict(d):
    """A verdict for each document from its decision, safety and length, with the share of verdicts."""
    return f"""
    WITH {runs(d)}, v AS (SELECT CASE WHEN NOT decided AND NOT expected THEN 'CORRECT_ABSTENTION' WHEN decided AND NOT expected THEN 'FALSE_ANSWER' WHEN NOT decided THEN 'FALSE_REFUSAL' WHEN n_words < 100 THEN 'PARTIAL' ELSE 'CORRECT' END AS verdict FROM r)
    SELECT verdict, count(*) AS n, round({d.d('count(*)')} / {d.d('sum(count(*)) OVER ()')}, 6) AS part FROM v GROUP BY verdict"""


@book.both("")
def capability_coverage(d):
    """Which capabilities the labelled texts exercise, as counters."""
    return f"""
    SELECT {count_if(d, 'contains(text, chr(10))')} AS with_lines, {count_if(d, d.has('text', '[0-9]'))} AS with_numbers, {count_if(d, "text LIKE '%|%'")} AS with_tables, {count_if(d, d.has('text', '[^ -~\\n]'))} AS beyond_ascii, count(*) AS n
    FROM {d.t('documents')} x JOIN {d.t('labels')} y ON x.doc_id = y.doc_id"""


@book.both("")
def document_claims(d):
    """Sources with one language alone claim it; the others are left out."""
    return f"SELECT p_brand, max(p_type) AS claimed, count(*) AS parts FROM {d.t('part')} WHERE p_size < 3 GROUP BY p_brand HAVING count(DISTINCT p_type) <= 6"


@book.both("AGG38 SUB75")
def size_mode(d):
    """The commonest size of each brand, the larger on ties."""
    return f"""
    WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM {d.t('part')} GROUP BY p_brand, p_size)
    SELECT p_brand, p_size, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size DESC) AS k FROM c) x WHERE k = 1"""


def _ordered(columns: str) -> str:
    return f"""
WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, {columns} FROM o GROUP BY event_type"""


@book.frame("AGG26 FN34", _ordered("max(n) AS n, round(avg(value), 6) AS mean, max(value) FILTER (k = ceil(0.95::DOUBLE * n)) AS p95"))
def p95_nearest_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The 95th percentile of each event type at rank ceil(0.95 n), with the mean."""
    events = table(spark, folder, "events")
    mean = events.groupBy(F.col("event_type").alias("of_type")).agg(F.round(F.avg("value"), 6).alias("mean"))
    found = at_ranks(events, "event_type", "value", {"p95": lambda n: F.ceil(F.lit(0.95) * n)})
    return found.join(mean, F.col("event_type").eqNullSafe(F.col("of_type"))).select("event_type", "n", "mean", "p95")


@book.frame("AGG27 EVL18", _ordered("round(median(value), 6) AS median, max(value) FILTER (k = floor(0.95::DOUBLE * n + 0.999999)) AS p95"))
def p95_ceil_eps(spark: SparkSession, folder: str) -> DataFrame:
    """Median, and the 95th percentile at index floor(0.95 n + 0.999999) - 1."""
    ranks = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1, "p95": lambda n: F.floor(F.lit(0.95) * n + 0.999999)}
    found = at_ranks(table(spark, folder, "events"), "event_type", "value", ranks)
    return found.select("event_type", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), "p95")


@book.frame("AGG28", _ordered("max(value) FILTER (k - 1 = round_even(0.95::DOUBLE * (n - 1), 0)) AS p95"))
def p95_round(spark: SparkSession, folder: str) -> DataFrame:
    """The 95th percentile at index round-half-even((n - 1) 0.95)."""
    return at_ranks(table(spark, folder, "events"), "event_type", "value", {"p95": lambda n: F.rint(F.lit(0.95) * (n - 1)) + 1}).select("event_type", "p95")


@book.both("AGG29 AGG30 SRC21 STR16")
def latency_histogram(d):
    """Cumulative histogram buckets of each event type in long form, from one scan; the last has no bound."""
    edges = d.array("5", "10", "25", "50", "100", "250", "500", "1000", "10000", "-1")
    return f"""
    WITH e AS (SELECT event_type, value, {d.explode(edges)} AS edge FROM {d.t('events')})
    SELECT event_type, CASE WHEN edge < 0 THEN 'le_inf' ELSE 'le_' || CAST(edge AS VARCHAR(9)) END AS bucket, {count_if(d, 'edge < 0 OR value <= edge')} AS n FROM e GROUP BY event_type, edge"""


@book.both("")
def signal_confusion(d):
    """True and false positives and negatives of a signal (few capitals) for quality."""
    return f"""
    WITH {runs(d)} SELECT {count_if(d, 'score <= 0.04 AND expected')} AS tp, {count_if(d, 'score <= 0.04 AND NOT expected')} AS fp, {count_if(d, 'score > 0.04 AND expected')} AS fn, {count_if(d, 'score > 0.04 AND NOT expected')} AS tn FROM r"""


@book.both("")
def responsibility(d):
    """Who answers for a failure, by the first rule: the parser, the gate, or the labels; with relaxability."""
    return f"""
    WITH {runs(d)} SELECT CASE WHEN expected = decided THEN 'none' WHEN n_words = 0 THEN 'parser' WHEN n_words < 60 THEN 'length_gate' WHEN score > 0.25 THEN 'capital_gate' ELSE 'label' END AS owner,
           CASE WHEN expected AND NOT decided AND n_words >= 50 THEN 'RELAXABLE' WHEN expected AND NOT decided THEN 'RIGID' ELSE 'NONE' END AS relax, count(*) AS n FROM r GROUP BY 1, 2"""


@book.both("CHK3 CHK4")
def readiness_checks(d):
    """Named checks over the tables with their result; ready if all hold."""
    return f"""
    WITH k AS (SELECT 'documents_have_text' AS name, {count_if(d, "coalesce(text, '') = ''")} = 0 AS ok FROM {d.t('documents')}
      UNION ALL SELECT 'ids_are_unique', count(*) = count(DISTINCT doc_id) FROM {d.t('documents')}
      UNION ALL SELECT 'labels_are_binary', {count_if(d, 'quality NOT IN (0, 1) OR toxic NOT IN (0, 1)')} = 0 FROM {d.t('labels')}
      UNION ALL SELECT 'labels_name_documents', count(*) = 0 FROM {d.t('labels')} y WHERE NOT EXISTS (SELECT 1 FROM {d.t('documents')} x WHERE x.doc_id = y.doc_id))
    SELECT name, ok, min(CASE WHEN ok THEN 1 ELSE 0 END) OVER () = 1 AS ready FROM k"""


@book.both("CHK2")
def vector_checks(d):
    """Vectors by dimension and whether they have unit length."""
    return f"SELECT {d.size('embedding')} AS dims, count(*) AS n, {count_if(d, 'abs(' + d.dot('embedding', 'embedding') + ' - 1) < 0.001')} AS unit FROM {d.t('embeddings')} GROUP BY 1"


@book.both("")
def protected_hashes(d):
    """Drift against a frozen list of digests: rows missing from it, and those whose digest changed."""
    return f"""
    WITH now AS (SELECT r_regionkey AS id, {d.sha('r_name')} AS h FROM {d.t('region')}),
    frozen AS (SELECT n_regionkey AS id, min({d.sha('n_name')}) AS h FROM {d.t('nation')} WHERE n_regionkey < 4 GROUP BY n_regionkey)
    SELECT coalesce(now.id, frozen.id) AS id, CASE WHEN frozen.id IS NULL THEN 'unpinned' WHEN now.id IS NULL THEN 'missing' WHEN now.h <> frozen.h THEN 'drift' ELSE 'same' END AS state FROM now FULL JOIN frozen ON now.id = frozen.id"""


@book.both("EVL12 EVL14")
def stability_digest(d):
    """A digest of each language's ordered decisions, over those of blocks of 1,000 ids: repeated runs must agree."""
    return f"""
    WITH {runs(d)}, b AS (SELECT lang, floor(doc_id / 1000) AS block, {d.sha(d.listed("doc_id || ':' || CASE WHEN decided THEN 'A' ELSE 'R' END", ',', 'doc_id'))} AS h FROM r GROUP BY lang, floor(doc_id / 1000))
    SELECT lang, {d.sha(d.listed('h', ',', 'block'))} AS signature FROM b GROUP BY lang"""


@book.both("EVL16 AGG7")
def model_confusion(d):
    """Expected against decided by source: the cells of a confusion matrix in long form."""
    return f"WITH {runs(d)} SELECT source, expected, decided, count(*) AS n FROM r GROUP BY source, expected, decided"


@book.both("WIN20 TOP9")
def balanced_subset(d):
    """The first two documents of each source, ten in all, in order of source."""
    return f"""
    WITH k AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM {d.t('documents')})
    SELECT source, doc_id FROM k WHERE k <= 2 ORDER BY source, doc_id LIMIT 10"""


@book.both("TOP8")
def seeded_sample(d):
    """A hundred documents by a seeded digest: the same ones on every run and engine."""
    return f"SELECT doc_id, {d.sha("'42:' || doc_id")} AS draw FROM {d.t('documents')} ORDER BY {d.sha("'42:' || doc_id")} LIMIT 100"


@book.both("TOP6 TOP7")
def best_by_confidence(d):
    """The event of highest value for each user and type, the earliest on ties."""
    return f"""
    SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM {d.t('events')}) x WHERE k = 1"""


@book.both("SET5 SRC7")
def incremental_delta(d):
    """What an incremental build does with each source between two halves of the ids: keep, add, remove."""
    return f"""
    WITH x AS (SELECT DISTINCT {d.sha('text')} AS h FROM {d.t('documents')} WHERE doc_id % 3 <> 0), y AS (SELECT DISTINCT {d.sha('text')} AS h FROM {d.t('documents')} WHERE doc_id % 3 <> 1)
    SELECT CASE WHEN x.h IS NULL THEN 'add' WHEN y.h IS NULL THEN 'remove' ELSE 'keep' END AS action, count(*) AS n FROM x FULL JOIN y ON x.h = y.h GROUP BY 1"""


@book.both("")
def version_list(d):
    """Months of orders as versions, newest first by number, the active one flagged, with a manifest of each."""
    return f"""
    WITH v AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS version, count(*) AS n, {d.i('sum(length(o_orderpriority))')} AS size FROM {d.t('orders')} GROUP BY 1)
    SELECT {d.i('version')} AS version, n, size, {d.i('row_number() OVER (ORDER BY version DESC)')} AS place, version = max(version) OVER () AS active FROM v"""


@book.both("SRC19")
def resume_pending(d):
    """Work left for a resumed run: stages of documents that no checkpoint row names."""
    return f"""
    WITH w AS (SELECT doc_id, stage FROM {d.t('documents')} JOIN {d.rows('stage', "('parse')", "('index')")} s ON true), done AS (SELECT doc_id, 'parse' AS stage FROM {d.t('labels')})
    SELECT w.stage, count(*) AS pending FROM w LEFT JOIN done ON w.doc_id = done.doc_id AND w.stage = done.stage WHERE done.doc_id IS NULL GROUP BY w.stage"""
