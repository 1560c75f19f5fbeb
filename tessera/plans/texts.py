"""Text functions, ingestion and segmentation over documents, pages and conversations."""

from __future__ import annotations

from tessera.plans.dialect import Book

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS


@book.both("FN27 FN28 SET1 FN31")
def chunk_ids_dedupe(d):
    """Stable document and chunk ids from SHA-256, the first chunk of an id kept."""
    return f"""
    WITH l AS ({d.places('doc_id, source', d.split('text', chr(10)), d.t('documents'), 'line', 'content')}),
    c AS (SELECT *, 'doc-' || substr({d.sha('source')}, 1, 24) AS document_id, substr({d.sha("source || '|' || content")}, 1, 24) AS chunk_id FROM l WHERE trim(content) <> '')
    SELECT document_id, chunk_id, doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id, line) AS rn FROM c) x WHERE rn = 1"""


@book.both("ING3")
def lang_ratio(d):
    """Latin letters against other letters, with a label for mixed texts."""
    return f"""
    WITH c AS (SELECT doc_id, {d.length(d.sub('text', '[^A-Za-z]', ''))} AS latin, {d.length(d.sub('text', '[\\x00-\\x7F]', ''))} AS other FROM {d.t('documents')})
    SELECT doc_id, latin, other, CASE WHEN latin + other = 0 THEN 'unknown' WHEN least(latin, other) >= 0.2 * greatest(latin, other) THEN 'mixed'
           WHEN latin > other THEN 'latin' ELSE 'other' END AS kind FROM c"""


@book.both("ING7")
def doc_title(d):
    """The first of the first forty lines that has 3 to 120 characters and is no label."""
    ok = f"length(trim(l)) BETWEEN 3 AND 120 AND NOT {d.has('l', '^[A-Za-z ]{1,20}:')}"
    return f"""
    SELECT doc_id, trim({d.at(d.only(d.slice(d.split('text', chr(10)), 1, 40), 'l', ok), 1)}) AS title FROM {d.t('documents')}"""


@book.both("")
def doc_classify(d):
    """A first-match cascade of rules to a kind of document."""
    return f"""
    SELECT doc_id, CASE WHEN {d.size(d.find_all('text', '[A-Z]{2,}[0-9]{2,}'))} >= 2 THEN 'codes' WHEN {d.has('lower(text)', 'licen[sc]ed? under|copyright')} THEN 'licence'
           WHEN {d.has('lower(text)', '(?:password|secret|token|api_?key) *[:=]')} THEN 'credential' WHEN text LIKE '%|%|%' THEN 'table'
           WHEN {d.size(d.split('text', chr(10)))} > 40 THEN 'manual' ELSE 'general' END AS kind FROM {d.t('documents')}"""


@book.both("")
def section_units(d):
    """Lines of pages with the heading in force: the last heading line before them, numbered by a running sum."""
    return f"""
    WITH l AS ({d.places('page_id', d.split('html', chr(10)), d.t('pages'), 'line', 'content')}),
    h AS (SELECT *, {d.find('content', '<h[1-6][^>]*>([^<]*)', 1)} AS heading, CASE WHEN {d.has('content', '<h[1-6]')} THEN 1 ELSE 0 END AS starts FROM l)
    SELECT page_id, line, {d.i('sum(starts) OVER (PARTITION BY page_id ORDER BY line)')} AS unit,
           {d.last('CASE WHEN starts = 1 THEN heading END')} OVER (PARTITION BY page_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h"""


@book.both("ING13 TBL10 WIN12")
def block_segments(d):
    """Blocks of lines between lines that have no letter, as gaps and islands; the longest block of each document, first on ties."""
    return f"""
    WITH l AS ({d.places('doc_id', d.split('text', chr(10)), d.t('documents'), 'line', 'content')}),
    b AS (SELECT *, sum(CASE WHEN {d.has('content', '[a-z]')} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM l),
    g AS (SELECT doc_id, block, min(line) AS first_line, count(*) AS n FROM b WHERE {d.has('content', '[a-z]')} GROUP BY doc_id, block)
    SELECT doc_id, first_line, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_line) AS r FROM g) x WHERE r = 1"""


@book.both("ING14 WIN22")
def chunk_split(d):
    """Texts cut every 650 characters into pieces of 800, so that neighbours share 150; the index of each piece, its place and digest."""
    n = f"greatest(0, CAST(ceil((length(text) - 150) / {d.d('650')}) AS BIGINT) - 1)"
    return f"""
    WITH c AS ({d.places('doc_id, text', d.up_to('CAST(0 AS BIGINT)', n), d.t('documents'), 'k', 'i')})
    SELECT doc_id, i AS chunk_index, i * 650 AS start, {d.length('substr(text, CAST(i * 650 + 1 AS INT), 800)')} AS n_chars, substr({d.sha('substr(text, CAST(i * 650 + 1 AS INT), 800)')}, 1, 16) AS digest FROM c"""


@book.both("WIN7 EXP38")
def sliding_3_lines(d):
    """Windows of a line and the two after it: how long they are and whether the last one ends a sentence."""
    return f"""
    WITH l AS ({d.places('doc_id', d.split('text', chr(10)), d.t('documents'), 'line', 'content')}),
    w AS (SELECT doc_id, line, sum(length(content)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n,
                 last_value(content) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS last_line FROM l)
    SELECT doc_id, line, {d.i('n')} AS n_chars, last_line LIKE '%.' AS ends_sentence FROM w"""


@book.both("WIN8 WIN9")
def sliding_16_lines(d):
    """Windows of 16 lines; one window where a text has 16 lines or fewer."""
    return f"""
    WITH s AS (SELECT doc_id, {d.split('text', chr(10))} AS lines FROM {d.t('documents')}),
    w AS ({d.places('doc_id, lines', d.up_to('CAST(0 AS BIGINT)', f"greatest(0, {d.size('lines')} - 16)"), 's', 'k', 'i')})
    SELECT doc_id, i AS window_start, {d.length(d.join(d.slice('lines', 'CAST(i + 1 AS INT)', '16'), ' '))} AS n_chars FROM w"""


@book.both("WIN10 HAR36 HAR35 SUB25")
def quote_windows(d):
    """110 characters on both sides of the first word of at least twelve letters."""
    return f"""
    WITH m AS (SELECT doc_id, text, {d.find('text', '[A-Za-z]{12,}')} AS word FROM {d.t('documents')}),
    p AS (SELECT *, {d.i('instr(text, word)')} AS pos FROM m WHERE word <> '')
    SELECT doc_id, word, pos, substr(text, CAST(greatest(pos - 110, 1) AS INT), CAST(pos + length(word) + 109 - greatest(pos - 110, 1) + 1 AS INT)) AS quote FROM p"""


@book.both("")
def sentence_value_support(d):
    """Sentences that hold a number and an article, with the first number and how many there are."""
    return f"""
    WITH s AS ({d.places('doc_id', d.split('text', '[.] '), d.t('documents'), 'sentence', 'content')})
    SELECT doc_id, sentence, {d.find('content', '[0-9]+')} AS value, {d.size(d.find_all('content', '[0-9]+'))} AS n_values FROM s WHERE {d.has('content', '[0-9]')} AND {d.has('lower(content)', '(?:^|[^a-z])(the|der|la|le)(?:[^a-z]|$)')}"""


@book.both("FN29 FN43 FN8 FN7")
def white_space_folding(d):
    """Whitespace as one space, trimmed; and a form without hyphens and spaces."""
    return f"""
    SELECT doc_id, {d.sha(f"trim({d.sub('text', '[ \\t\\n\\r]+', ' ')})")} AS folded, {d.length(d.sub('lower(text)', '[- \\t\\n\\r]+', ''))} AS bare FROM {d.t('documents')}"""


@book.both("FN10 FN9 FN14")
def whole_token_mentions(d):
    """Documents that mention whole words of a list, with how often; neighbours must be no letters."""
    return f"""
    WITH v AS (SELECT * FROM {d.rows('word', "('the')", "('licensed')", "('version')", "('password')")}),
    t AS (SELECT doc_id, {d.explode(d.find_all('lower(text)', '[a-z0-9]+'))} AS word FROM {d.t('documents')})
    SELECT doc_id, t.word, count(*) AS n FROM t JOIN v ON t.word = v.word GROUP BY doc_id, t.word"""


@book.both("FN12 FN13 FN17 FN38")
def number_unit_pairs(d):
    """Numbers with the word that follows, from all documents: how often each unit-like word occurs and the numbers' range."""
    return f"""
    WITH p AS (SELECT {d.explode(d.find_all('lower(text)', '[0-9]+(?:[.][0-9]+)? [a-z]+'))} AS pair FROM {d.t('documents')}),
    s AS (SELECT {d.d(d.find('pair', '^([0-9.]+) ', 1))} AS value, {d.find('pair', ' ([a-z]+)$', 1)} AS unit FROM p)
    SELECT unit, count(*) AS n, min(value) AS low, max(value) AS high FROM s GROUP BY unit"""


@book.both("")
def unit_tolerance_match(d):
    """Every 50th part asks with its size for parts within one percent of it, whatever their unit; sizes are gathered by value and unit first."""
    return f"""
    WITH a AS (SELECT * FROM {d.rows('alias, unit, factor', "('mm', 'm', 0.001)", "('m', 'm', 1.0)", "('kv', 'v', 1000.0)", "('v', 'v', 1.0)")}),
    p AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'mm' WHEN 2 THEN 'v' ELSE 'kv' END AS alias, CASE WHEN p_partkey % 4 = 1 THEN 1000 * p_size + p_partkey % 7 WHEN p_partkey % 4 = 3 THEN p_size / {d.d('1000')} ELSE {d.d('p_size')} END AS value FROM {d.t('part')}),
    n AS (SELECT id, unit, round({d.d('value')} * {d.d('factor')}, 6) AS size FROM p JOIN a ON p.alias = a.alias),
    r AS (SELECT unit, size, count(*) AS parts, min(id) AS first_part FROM n GROUP BY unit, size),
    q AS (SELECT DISTINCT unit, size FROM n WHERE id % 50 = 0)
    SELECT q.unit, q.size AS wanted, {d.i('sum(parts)')} AS parts, min(first_part) AS first_part FROM q JOIN r ON q.unit = r.unit AND abs(r.size - q.size) <= 0.01 * q.size + 0.0000005 GROUP BY q.unit, q.size"""


@book.both("FN20 FN22 FN23")
def stemmed_keywords(d):
    """Words of four letters and more without their ending: distinct forms of each stem."""
    return f"""
    WITH w AS (SELECT DISTINCT word FROM (SELECT {d.explode(d.find_all('lower(text)', '[a-z]{4,}'))} AS word FROM {d.t('benchmark')}) x),
    s AS (SELECT word, {d.sub('word', '(?:ies|es|s|ed|ing|d)$', '')} AS stem FROM w)
    SELECT stem, count(*) AS forms, {d.listed('word', ',', 'word')} AS words FROM s GROUP BY stem"""


@book.both("FN21 FLT10 FLT12 EVD13")
def polarity_cues(d):
    """Which cues a text has, as flags and as a list in fixed order."""
    cues = {"negation": "(?:^|[^a-z])(?:not|no|nicht|kein|ne|pas)(?:[^a-z]|$)", "question": "[?]", "credential": "(?:password|secret|token) *[:=]", "licence": "licensed under"}
    return f"""
    SELECT doc_id, {', '.join(f"{d.has('lower(text)', p)} AS {n}" for n, p in cues.items())},
           {d.i(' + '.join(f"CASE WHEN {d.has('lower(text)', p)} THEN 1 ELSE 0 END" for p in cues.values()))} AS n FROM {d.t('documents')}"""


@book.both("FN35 FN36 FN48")
def label_cleaning(d):
    """Labels cut to 64 characters with odd ones replaced, a check of ids, and a stable suffix."""
    return f"""
    SELECT page_id, {d.sub('substr(url, 1, 64)', '[^A-Za-z0-9_.-]', '_')} AS label, {d.has('url', '^[A-Za-z0-9:/._-]+$')} AS valid, substr({d.sha("url || '|' || html")}, 1, 12) AS suffix FROM {d.t('pages')}"""


@book.both("FN41 FN42 FN45 WIN21")
def token_estimates(d):
    """A quarter of the characters as tokens, one at least, by source; with a batch for every 24,000 characters of the running sum."""
    return f"""
    WITH b AS (SELECT doc_id, source, {d.length('text')} AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM {d.t('documents')})
    SELECT source, {d.i('floor((upto - n) / 24000)')} AS batch, count(*) AS docs, {d.i('sum(greatest(floor(n / 4), 1))')} AS tokens FROM b GROUP BY source, {d.i('floor((upto - n) / 24000)')}"""


@book.both("FN46")
def softmax3(d):
    """A softmax over three scores of each document (letters, digits, spaces per character), to six places."""
    return f"""
    WITH s AS (SELECT doc_id, {d.d(f"length({d.sub('text', '[^A-Za-z]', '')})")} / greatest(length(text), 1) AS a, {d.d(f"length({d.sub('text', '[^0-9]', '')})")} / greatest(length(text), 1) AS b,
                      {d.d(f"length({d.sub('text', '[^ ]', '')})")} / greatest(length(text), 1) AS c FROM {d.t('documents')}),
    m AS (SELECT *, greatest(a, b, c) AS m FROM s)
    SELECT doc_id, round(exp(a - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) AS p_letters, round(exp(b - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) AS p_digits FROM m"""


@book.both("FN49 FN47")
def letter_spacing(d):
    """Runs of single letters with spaces between them, and what they are together."""
    return f"""
    SELECT doc_id, {d.find('text', '(?:[A-Za-z] ){3,}[A-Za-z]')} AS spaced, {d.sub(d.find('text', '(?:[A-Za-z] ){3,}[A-Za-z]'), ' ', '')} AS joined FROM {d.t('documents')} WHERE {d.has('text', '(?:[A-Za-z] ){3,}[A-Za-z]')}"""


@book.both("FN50 SUB65 JOIN16")
def lattice_containment(d):
    """Points (quantity, price) after an affine map, in the cell of a lattice that holds them."""
    return f"""
    WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS x, l_extendedprice / 1000 - l_quantity AS y FROM {d.t('lineitem')} WHERE l_orderkey % 10 < 10),
    v AS (SELECT * FROM {d.rows('col, x0, x1', '(0, 0.0, 25.0)', '(1, 25.0, 60.0)', '(2, 60.0, 200.0)')}),
    h AS (SELECT * FROM {d.rows('row, y0, y1', '(0, -100.0, 0.0)', '(1, 0.0, 20.0)', '(2, 20.0, 200.0)')})
    SELECT h.row, v.col, count(*) AS n, round(min(x), 2) AS x, round(max(y), 4) AS y FROM p JOIN v ON x >= {d.d('x0')} AND x < {d.d('x1')} JOIN h ON y >= {d.d('y0')} AND y < {d.d('y1')} GROUP BY h.row, v.col"""


@book.both("")
def layout_cells(d):
    """Cells of table-like lines, cut at bars: lines by their number of cells and how wide the cells are."""
    return f"""
    WITH l AS ({d.places('doc_id', d.split('text', chr(10)), d.t('documents'), 'line', 'content')}),
    c AS ({d.places('doc_id, line', d.split('content', ' [|] '), "(SELECT * FROM l WHERE content LIKE '%|%') t", 'cell', 'value')})
    SELECT doc_id, line, count(*) AS cells, {d.i('max(length(value))')} AS widest, {d.i("sum(CASE WHEN trim(value) = '' THEN 1 ELSE 0 END)")} AS blank FROM c GROUP BY doc_id, line"""


@book.both("")
def vertical_spans(d):
    """Rows whose first cell repeats above them: runs of lines that start with the same letter, with two lines or more."""
    return f"""
    WITH l AS ({d.places('doc_id', d.split('text', chr(10)), d.t('documents'), 'line', 'content')}),
    f AS (SELECT doc_id, line, substr(content, 1, 1) AS head, CASE WHEN substr(content, 1, 1) = lag(substr(content, 1, 1)) OVER (PARTITION BY doc_id ORDER BY line) THEN 0 ELSE 1 END AS starts FROM l),
    r AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM f)
    SELECT doc_id, min(line) AS first_line, max(line) AS last_line, min(head) AS head FROM r GROUP BY doc_id, run HAVING count(*) >= 2"""


@book.both("CNV9")
def prompt_blocks(d):
    """Numbered source blocks of the first three documents of each source, whole and in order, as the digest of one string."""
    return f"""
    WITH r AS (SELECT source, doc_id, text AS head, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM {d.t('documents')})
    SELECT source, {d.sha(d.listed("'[S' || k || '] ' || head", ' # ', 'k'))} AS prompt FROM r WHERE k <= 3 GROUP BY source"""


@book.both("SRC15 FN32 FN33 SRC18")
def build_fingerprint(d):
    """A digest of each source's ordered rows, over those of blocks of 1,000 ids: equal inputs give equal fingerprints."""
    return f"""
    WITH b AS (SELECT source, floor(doc_id / 1000) AS block, count(*) AS n, {d.sha(d.listed("doc_id || ':' || substr(" + d.sha('text') + ", 1, 12)", ',', 'doc_id'))} AS h FROM {d.t('documents')} GROUP BY source, floor(doc_id / 1000))
    SELECT source, {d.sha(d.listed('h', ',', 'block'))} AS fingerprint, {d.i('sum(n)')} AS n FROM b GROUP BY source"""


@book.both("HAR5 HAR6 HAR7")
def multi_key_leakage(d):
    """Pages that share a host, a path or the whole address with another page, each key by itself; blanks never match."""
    keys = {"host": d.find("url", "^[a-z]+://([^/]+)", 1), "path": d.find("url", "^[a-z]+://[^/]+(/.*)$", 1), "url": "url"}
    union = " UNION ALL ".join(f"SELECT page_id, '{n}' AS kind, {e} AS k FROM {d.t('pages')}" for n, e in keys.items())
    return f"""
    WITH k AS (SELECT * FROM ({union}) u WHERE k <> ''), s AS (SELECT kind, k FROM k GROUP BY kind, k HAVING count(*) > 1)
    SELECT k.kind, count(*) AS pages, count(DISTINCT k.k) AS shared FROM k JOIN s ON k.kind = s.kind AND k.k = s.k GROUP BY k.kind"""


@book.both("")
def page_ranges(d):
    """Headings and links of each page, and the number of pages with each number of headings."""
    return f"""
    WITH p AS (SELECT page_id, {d.size(d.find_all('html', '<h[1-6]'))} AS headings, {d.size(d.find_all('html', '<a '))} AS links, {d.size(d.find_all('html', '<p'))} AS paragraphs FROM {d.t('pages')})
    SELECT headings, count(*) AS pages, {d.i('sum(links)')} AS links, {d.i('sum(paragraphs)')} AS paragraphs FROM p GROUP BY headings"""


@book.both("SET8")
def duplicate_audit(d):
    """Texts that occur more than once: size of the group, first id and the digest that names it."""
    return f"""
    SELECT {d.sha('text')} AS digest, count(*) AS n, min(doc_id) AS first_id FROM {d.t('documents')} GROUP BY {d.sha('text')} HAVING count(*) > 1"""


@book.both("SET2 SET3 SET9")
def ordered_distinct(d):
    """Distinct lower-cased first words by source in order of first appearance."""
    return f"""
    WITH f AS (SELECT source, lower({d.find('text', '[A-Za-z]+')}) AS word, min(doc_id) AS first_id FROM {d.t('documents')} GROUP BY source, lower({d.find('text', '[A-Za-z]+')}))
    SELECT source, {d.listed('word', ',', 'first_id, word')} AS words, count(*) AS n FROM f WHERE word <> '' GROUP BY source"""


@book.both("")
def conversation_summary(d):
    """The last three user turns of each conversation, whole and in order, as the digest of one string."""
    return f"""
    WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {d.t('conversations')} WHERE role = 'user')
    SELECT conv_id, {d.sha(d.listed('text', ' / ', 'turn'))} AS summary, count(*) AS turns, {d.i('sum(length(text))')} AS n_chars FROM u WHERE back <= 3 GROUP BY conv_id"""


@book.both("WIN14 CNV10")
def recent_turns(d):
    """The last four turns of each conversation, whole, as the digest of a message list; how many older ones go to the summary."""
    return f"""
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM {d.t('conversations')})
    SELECT conv_id, max(n) - count(*) AS older, {d.sha(d.listed("role || ':' || text", ' | ', 'turn'))} AS messages FROM b WHERE back <= 4 GROUP BY conv_id"""


@book.both("WIN15 CNV2")
def budget_trim(d):
    """Turns from the newest back while characters and 12 for each turn stay within 600; the newest is cut rather than dropped."""
    return f"""
    WITH b AS (SELECT conv_id, turn, length(text) + 12 AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back,
                      sum(length(text) + 12) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM {d.t('conversations')})
    SELECT conv_id, turn, {d.i('least(cost - 12, 588)')} AS kept_chars FROM b WHERE used <= 600 OR back = 1"""


@book.both("WIN16 CNV1")
def front_drop(d):
    """Turns dropped from the front until the rest fits 900 characters, with the status of each conversation."""
    return f"""
    WITH b AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS rest FROM {d.t('conversations')})
    SELECT conv_id, {d.i('sum(CASE WHEN rest <= 900 THEN 1 ELSE 0 END)')} AS kept, {d.i('sum(CASE WHEN rest > 900 THEN 1 ELSE 0 END)')} AS dropped,
           CASE WHEN max(rest) <= 900 THEN 'complete' WHEN min(rest) > 900 THEN 'empty' ELSE 'trimmed' END AS status FROM b GROUP BY conv_id"""


@book.both("")
def topic_tracking(d):
    """The topic of each turn: its user turn's first long word, carried on until the next one."""
    return f"""
    WITH w AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {d.find('lower(text)', '[a-z]{7,}')} END AS word FROM {d.t('conversations')})
    SELECT conv_id, turn, role, {d.last("CASE WHEN word <> '' THEN word END")} OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS topic FROM w"""
