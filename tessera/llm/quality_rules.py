"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Every rule is a whole number, and its sketch is the number of documents for each bin, where
a bin is a number's first six binary digits: sketches merge by adding, hold some hundreds
of counts however many documents they cover, give the same quantile in any order of
merging, and are exact to a thirty-second part. Only documents that the base rules leave
are sketched. A group's threshold is its own at heart, drawn towards that of its language
and of all the more, the fewer documents it has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import WORD, bounded, settle, table, whole, words

#: For each rule two percentiles and a reach: the threshold is the upper one and so many times the distance between them.
#: Repeats have a long clean tail, hence the high percentile; the others are told by their middle.
RULES = {"repeat": (50, 99, 1), "symbol": (50, 75, 4), "line": (50, 99, 1), "upper": (25, 75, 4), "length": (25, 75, 4)}
#: A group's threshold counts as its documents, that of the next larger group as so many.
DRAWN = 200
#: What a document has too much of must be so many standard deviations (of a count) above the threshold.
SURE = 3

_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Each rule's count, what it is a share of, and the unit.
_SHARES = {
    "repeat": ("n_repeat_words", "n_words", 100_000), "symbol": ("n_symbols", "word_chars", 100_000), "line": ("n_dup_lines", "n_lines", 100_000),
    "upper": ("n_upper", "word_chars", 100_000), "length": ("word_chars", "n_words", 1000),
}


def measures(docs: DataFrame, every: bool = False) -> DataFrame:
    """row (doc_id, lang and source, or with ``every`` all columns), the base counts, base_failed, and each rule's share and least share.

    Null and empty texts have no words: all counts 0, base_failed true. Windows are
    counted in full: three-word windows are hashed first, and texts in which a hash
    repeats are settled by sorting the windows themselves, so no collision counts. The
    least share is what is left after SURE standard deviations of the count (none for the length).
    """
    bounded(docs.sparkSession)
    at = "w[i], w[i + 1], w[i + 2]"
    row = whole(docs) if every else F.struct("doc_id", "lang", "source").alias("row")
    rules = [f"{unit} * {n} div greatest({of}, 1) AS {r}" for r, (n, of, unit) in _SHARES.items()]
    least = [
        f"{unit} * {n if r == 'length' else f'greatest({n} - {SURE} * cast(ceil(sqrt({n})) AS bigint), 0)'} div greatest({of}, 1) AS {r}_least"
        for r, (n, of, unit) in _SHARES.items()
    ]
    return (
        docs.select(row, F.coalesce("text", F.lit("")).alias("t"))
        .withColumn("w", words(F.col("t")))
        .withColumn("n", F.size("w"))
        .withColumn("lines", F.expr(f"filter(split(t, '\\n'), l -> l rlike '{WORD}')"))
        .withColumn("h", F.expr(f"if(n < 4, array(), transform(sequence(0, n - 3), i -> xxhash64({at})))"))
        .withColumn(
            "k",
            F.expr(
                "if(size(array_distinct(h)) = size(h), array(), "
                f"sort_array(transform(sequence(0, n - 3), i -> struct(concat_ws(' ', {at}) AS s, i AS p))))"
            ),
        )
        .withColumn("twice", F.expr("filter(k, (x, j) -> (j > 0 AND get(k, j - 1).s = x.s) OR (j < size(k) - 1 AND get(k, j + 1).s = x.s))"))
        # inline() keeps a later filter on these from being pushed into, and so repeating, what they are made of.
        .selectExpr(
            "row",
            "inline(array(struct(cast(n AS bigint) AS n_words, "
            "cast(char_length(array_join(w, '')) AS bigint) AS word_chars, "
            "cast(regexp_count(t, '[#*$%&|<>]') AS bigint) AS n_symbols, "
            "cast(size(lines) - size(array_distinct(lines)) AS bigint) AS n_dup_lines, "
            "cast(size(array_distinct(flatten(transform(twice, x -> array(x.p, x.p + 1, x.p + 2))))) AS bigint) AS n_repeat_words, "
            "cast(size(lines) AS bigint) AS n_lines, "
            "cast(char_length(regexp_replace(t, '[^A-Z]+', '')) AS bigint) AS n_upper)))",
        )
        .withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
        .selectExpr("*", *rules, *least)
    )


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, rule, bin (its greatest number) and n: the sketch of each rule for each language and source."""
    rules = ", ".join(f"'{r}', {r}" for r in RULES)
    return (
        measured.where("NOT base_failed")
        .selectExpr("row.lang AS lang", "row.source AS source", f"stack({len(RULES)}, {rules}) AS (rule, v)")
        .withColumn("shift", F.expr("greatest(length(bin(v)) - 6, 0)"))
        .selectExpr("lang", "source", "rule", "shiftleft(shiftright(v, shift) + 1, shift) - 1 AS bin")
        .groupBy("lang", "source", "rule", "bin")
        .agg(F.count("*").alias("n"))
    )


def limits(sketched: DataFrame) -> DataFrame:
    """lang, source and the threshold of each rule, inclusive, for every group.

    Sketches of a language, and of all, are merged from those of the groups. Groups are
    few against documents, and a group's sketch has a bounded number of bins.
    """
    low, high, reach = (F.create_map(*(F.lit(x) for r, v in RULES.items() for x in (r, v[i]))) for i in range(3))

    def level(keys: list[str], name: str) -> DataFrame:
        merged = sketched.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
        group = W.partitionBy(*keys, "rule")
        at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("all") * q[F.col("rule")], F.col("bin")))
        return (
            merged.withColumn("upto", F.sum("n").over(group.orderBy("bin")))
            .withColumn("all", F.sum("n").over(group))
            .groupBy(*keys, "rule")
            .agg(F.max("all").alias(f"{name}_n"), at(low).alias("lower"), at(high).alias("upper"))
            .select(
                *(F.col(k).alias(f"{name}_{k}") for k in keys), F.col("rule").alias(f"{name}_rule"), f"{name}_n",
                (F.col("upper") + reach[F.col("rule")] * (F.col("upper") - F.col("lower"))).alias(f"{name}_limit"),
            )
        )

    own, tongue, every = level(["lang", "source"], "g"), level(["lang"], "l"), level([], "a")
    drawn = f"(l_n * l_limit + {DRAWN} * a_limit) div (l_n + {DRAWN})"
    found = (
        own.join(tongue, F.col("g_lang").eqNullSafe(F.col("l_lang")) & (F.col("g_rule") == F.col("l_rule")))
        .join(every, F.col("g_rule") == F.col("a_rule"))
        .selectExpr("g_lang AS lang", "g_source AS source", "g_rule AS rule", f"(g_n * g_limit + {DRAWN} * ({drawn})) div (g_n + {DRAWN}) AS top")
    )
    return found.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rule") == r, F.col("top"))).alias(f"{r}_limit") for r in RULES))


def judge(measured: DataFrame, limited: DataFrame) -> DataFrame:
    """``measured`` with kept: false if base_failed or if a rule's least share is above its group's threshold.

    A group without thresholds has no document that the base rules leave.
    """
    g = limited.select(F.struct("lang", "source").alias("group"), *(f"{r}_limit" for r in RULES))
    within = reduce(lambda a, b: a & b, (F.col(f"{r}_least") <= F.coalesce(f"{r}_limit", f"{r}_least") for r in RULES))
    joined = measured.join(g, F.col("row.lang").eqNullSafe(F.col("group.lang")) & F.col("row.source").eqNullSafe(F.col("group.source")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & within)


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, measures and verdict of each document; measured once, in a written table."""
    measured = settle(measures(docs))
    return judge(measured, settle(limits(sketches(measured)))).select("row.*", *_BASE, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns, whatever they are called.

    Texts are measured once and written beside their measures. Null and empty texts go,
    and repeated rows have the same verdict. An empty table gives no rows.
    """
    measured = settle(measures(docs, every=True), "snappy")
    return judge(measured, settle(limits(sketches(measured)))).where("kept").select("row.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document. Null and empty texts have no words and fail; null languages and sources are groups of their own; rows that repeat count each and have
    one verdict; very long texts count whole; a document on a threshold is kept. Extra columns are not read. No rows for no documents.
    """
    return assess(table(spark, folder, "documents")).select("doc_id", *_BASE, "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
windows AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS c FROM tri),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM windows WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN rep ON w.doc_id IS NOT DISTINCT FROM rep.doc_id),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100000 * n_repeat_words // greatest(n_words, 1) AS repeat, 100000 * n_symbols // greatest(word_chars, 1) AS symbol,
         100000 * n_dup_lines // greatest(n_lines, 1) AS line, 100000 * n_upper // greatest(word_chars, 1) AS upper,
         1000 * word_chars // greatest(n_words, 1) AS length,
         100000 * greatest(n_repeat_words - 3 * ceil(sqrt(n_repeat_words))::BIGINT, 0) // greatest(n_words, 1) AS repeat_least,
         100000 * greatest(n_symbols - 3 * ceil(sqrt(n_symbols))::BIGINT, 0) // greatest(word_chars, 1) AS symbol_least,
         100000 * greatest(n_dup_lines - 3 * ceil(sqrt(n_dup_lines))::BIGINT, 0) // greatest(n_lines, 1) AS line_least,
         100000 * greatest(n_upper - 3 * ceil(sqrt(n_upper))::BIGINT, 0) // greatest(word_chars, 1) AS upper_least
  FROM m),
long AS (
  SELECT lang, source, rule, ((v >> s) + 1 << s) - 1 AS bin FROM (
    SELECT lang, source, rule, v, greatest(length(bin(v)) - 6, 0)::INTEGER AS s FROM (
      UNPIVOT (SELECT lang, source, repeat, symbol, line, upper, length FROM b WHERE NOT base_failed) ON repeat, symbol, line, upper, length INTO NAME rule VALUE v))),
rules(rule, low, high, reach) AS (VALUES ('repeat', 50, 99, 1), ('symbol', 50, 75, 4), ('line', 50, 99, 1), ('upper', 25, 75, 4), ('length', 25, 75, 4)),
own AS (
  SELECT lang, source, rule, any_value(n) AS n, max(top) AS top FROM (
    SELECT lang, source, rule, n, min(bin) FILTER (100 * upto >= high * n) OVER g + reach * (min(bin) FILTER (100 * upto >= high * n) OVER g - min(bin) FILTER (100 * upto >= low * n) OVER g) AS top
    FROM (SELECT *, count(*) OVER (PARTITION BY lang, source, rule) AS n, count(*) OVER (PARTITION BY lang, source, rule ORDER BY bin) AS upto FROM long) JOIN rules USING (rule)
    WINDOW g AS (PARTITION BY lang, source, rule)) GROUP BY ALL),
tongue AS (
  SELECT lang, rule, any_value(n) AS n, max(top) AS top FROM (
    SELECT lang, rule, n, min(bin) FILTER (100 * upto >= high * n) OVER g + reach * (min(bin) FILTER (100 * upto >= high * n) OVER g - min(bin) FILTER (100 * upto >= low * n) OVER g) AS top
    FROM (SELECT *, count(*) OVER (PARTITION BY lang, rule) AS n, count(*) OVER (PARTITION BY lang, rule ORDER BY bin) AS upto FROM long) JOIN rules USING (rule)
    WINDOW g AS (PARTITION BY lang, rule)) GROUP BY ALL),
every AS (
  SELECT rule, max(top) AS top FROM (
    SELECT rule, min(bin) FILTER (100 * upto >= high * n) OVER g + reach * (min(bin) FILTER (100 * upto >= high * n) OVER g - min(bin) FILTER (100 * upto >= low * n) OVER g) AS top
    FROM (SELECT *, count(*) OVER (PARTITION BY rule) AS n, count(*) OVER (PARTITION BY rule ORDER BY bin) AS upto FROM long) JOIN rules USING (rule)
    WINDOW g AS (PARTITION BY rule)) GROUP BY ALL),
tops AS (
  SELECT own.lang, own.source, own.rule, (own.n * own.top + 200 * ((tongue.n * tongue.top + 200 * every.top) // (tongue.n + 200))) // (own.n + 200) AS top
  FROM own JOIN tongue ON own.lang IS NOT DISTINCT FROM tongue.lang AND own.rule = tongue.rule JOIN every ON own.rule = every.rule),
g AS (
  SELECT lang, source, max(top) FILTER (rule = 'repeat') AS a, max(top) FILTER (rule = 'symbol') AS b, max(top) FILTER (rule = 'line') AS c,
         max(top) FILTER (rule = 'upper') AS d, max(top) FILTER (rule = 'length') AS e
  FROM tops GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND repeat_least <= coalesce(a, repeat_least) AND symbol_least <= coalesce(b, symbol_least) AND line_least <= coalesce(c, line_least)
       AND upper_least <= coalesce(d, upper_least) AND length <= coalesce(e, length) AS kept
FROM b LEFT JOIN g ON b.lang IS NOT DISTINCT FROM g.lang AND b.source IS NOT DISTINCT FROM g.source
"""
