"""Product identities: how a question's relates to a chunk's, which chunks a question's scope holds, and which products it names.

Chunks of a product share its identity, so chunks are first gathered by identity: a count
and the first few ids. Questions meet identities by equal keys (model and alias, series,
family), never all identities, and never chunks. Names cut short meet terms through
an index of their long prefixes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = ["manufacturer", "family", "series", "model", "aliases"]
RELATIONS = ("EXACT_MODEL", "SAME_SERIES", "SAME_FAMILY")

# Dashes, identifiers, and words that name no product.
DASHES = "‐‑‒–—―−"
IDENTIFIER = r"(?i)(?<![a-z0-9])(?:0x[0-9a-f]+|[faceps]\d{2,5}|mw\d{1,5}|4\d{4})(?![a-z0-9])"
GENERIC = (
    "a", "an", "and", "are", "as", "at", "by", "can", "code", "does", "for", "from", "in", "is", "manual", "module", "of", "on", "or", "pc", "series",
    "system", "the", "to", "type", "user", "with", "without", "controller", "drive", "diagnostic", "diagnostics",
)


def normal(text: Column) -> Column:
    """A name in lower case with single spaces, dashes as spaces; null is empty."""
    one = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), DASHES, "-" * len(DASHES)), r"(?U)\s*-\s*", "-")
    shown = F.regexp_replace(F.regexp_replace(one, r"(?U)\s+", " "), r"^[ ,;:]+|[ ,;:]+$", "")
    return F.lower(F.regexp_replace(F.replace(shown, F.lit("-"), F.lit(" ")), " +", " "))


def _normal_all(names: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), normal), lambda n: n != ""))


def normalized(identities: DataFrame, *more: str) -> DataFrame:
    """``more`` and the identity's fields in normal form."""
    return identities.select(*more, *(normal(F.col(c)).alias(c) for c in FIELDS[:-1]), _normal_all(F.col("aliases")).alias("aliases"))


def relation(q: Column, c: Column) -> Column:
    """The relation of two identities (structs of ``normalized`` fields), the closest that holds."""
    named = lambda x: (x["family"] != "") | (x["series"] != "") | (x["model"] != "")
    both = lambda f: (q[f] != "") & (q[f] == c[f])
    return (
        F.when(~named(q) | ~named(c), "UNKNOWN")
        .when((q["manufacturer"] != "") & (c["manufacturer"] != "") & (q["manufacturer"] != c["manufacturer"]), "MISMATCH")
        .when((q["model"] != "") & F.array_contains(c["aliases"], q["model"]), "EXACT_MODEL")
        .when((q["series"] != "") & F.array_contains(q["aliases"], c["model"]), "SAME_SERIES")
        .when(both("series"), "SAME_SERIES").when(both("family"), "SAME_FAMILY").otherwise("MISMATCH")
    )


def gathered(chunks: DataFrame, first: int) -> DataFrame:
    """A row for each distinct identity of ``chunks`` (chunk_id, fields): its number of chunks and the least ``first`` ids."""
    n = normalized(chunks, "chunk_id").withColumn("identity", F.struct(*FIELDS))
    rank = F.row_number().over(W.partitionBy("identity").orderBy("chunk_id"))
    ids = n.withColumn("k", rank).where(F.col("k") <= first).groupBy("identity").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    return n.groupBy("identity").agg(F.count("*").alias("n")).join(ids, "identity")


def related(asked: DataFrame, identities: DataFrame) -> DataFrame:
    """(query_id, identity, n, ids, relation) for every identity that has one of RELATIONS to one of the question's.

    ``asked`` has query_id and fields, a row for each product that a question names. The closest relation of a question's products counts.
    """
    q = normalized(asked, "query_id").withColumn("q", F.struct(*FIELDS))
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    keys = lambda *named: F.filter(F.array_distinct(F.concat(*named)), lambda k: k["value"] != "")
    each = lambda kind, values: F.transform(values, lambda v: key(kind, v))
    col = F.col
    left = q.withColumn("key", F.explode(keys(F.array(key("model", col("model")), key("series", col("series")), key("family", col("family"))), each("alias", F.when(col("series") != "", col("aliases")).otherwise(F.array().cast("array<string>"))))))
    i = col("identity")
    right = identities.withColumn("key", F.explode(keys(each("model", i["aliases"]), F.array(key("alias", i["model"]), key("series", i["series"]), key("family", i["family"])))))
    pairs = left.select("query_id", "q", "key").join(right, "key").drop("key")
    found = pairs.withColumn("relation", relation(col("q"), i)).where(col("relation").isin(*RELATIONS))
    place = reduce(lambda a, b: a.when(col("relation") == b[1], b[0]), enumerate(RELATIONS[1:], 1), F.when(col("relation") == RELATIONS[0], 0))
    return found.groupBy("query_id", "identity").agg(F.first("n").alias("n"), F.first("ids").alias("ids"), F.min(place).alias("place"))


def scopes(questions: DataFrame, asked: DataFrame, chunks: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Each question's scope, and its first ``k`` chunks tier by tier.

    ``questions`` has query_id, confidence (EXACT_MODEL, SERIES, FAMILY or another value), resolved (the number of products found)
    and identifiers; ``chunks`` has chunk_id, the identity's fields and identifiers (of its text). The first
    result: query_id, requested, exact, series, family, everything (counts of chunks), identified (chunks that hold all identifiers). The second:
    query_id, rank, chunk_id, level, tier. Within a tier chunks come by id; a chunk
    stands in its first tier alone. Chunks with all identifiers come first, those inside the scope if there are any.
    """
    col = F.col
    # Earlier tiers hold fewer than k chunks wherever a later one is needed, so 2k of each identity are enough.
    some = related(asked, gathered(chunks, 2 * k))
    count = lambda most: F.sum(F.when(col("place") <= most, col("n")).otherwise(0))
    counts = some.groupBy("query_id").agg(count(0).alias("exact"), count(1).alias("series"), count(2).alias("family"))
    whole = chunks.agg(F.count("*").alias("everything"))
    q = questions.select("query_id", "confidence", F.coalesce("resolved", F.lit(0)).alias("resolved"), F.array_distinct(F.transform(F.coalesce("identifiers", F.array().cast("array<string>")), F.lower)).alias("wanted"))
    q = q.join(counts, "query_id", "left").na.fill(0, ["exact", "series", "family"]).join(F.broadcast(whole))  # one row
    requested = (
        F.when(col("resolved") > 1, "MULTI_IDENTITY_SCOPE").when((col("confidence") == "EXACT_MODEL") & (col("exact") > 0), "EXACT_MODEL_SCOPE").when(col("confidence") == "EXACT_MODEL", "UNKNOWN_SCOPE")
        .when(col("confidence") == "SERIES", "SERIES_SCOPE").when(col("confidence") == "FAMILY", "FAMILY_SCOPE").otherwise("GLOBAL_SCOPE")
    )
    q = q.withColumn("requested", requested)
    held = chunks.select("chunk_id", F.explode(F.array_distinct(F.transform("identifiers", F.lower))).alias("identifier"))
    hits = q.select("query_id", F.size("wanted").alias("need"), F.explode("wanted").alias("identifier")).join(held, "identifier")
    full = hits.groupBy("query_id", "chunk_id", "need").agg(F.count("*").alias("n")).where("n = need").select("query_id", "chunk_id")
    found = full.groupBy("query_id").agg(F.count("*").alias("identified"))
    q = q.join(found, "query_id", "left").na.fill(0, ["identified"])

    # Base tiers: for each question the tier of each relation; a question without any takes everything.
    wide = col("requested").isin("MULTI_IDENTITY_SCOPE", "EXACT_MODEL_SCOPE")
    tier = (
        F.when(wide & (col("place") == 0), 1).when(wide, 2)
        .when((col("requested") == "SERIES_SCOPE") & ((col("place") <= 1) | (col("series") == 0)), 1).when(col("requested") == "FAMILY_SCOPE", 1)
    )
    level = F.when(wide & (col("place") > 0), "FAMILY_SCOPE").otherwise(col("requested"))
    based = some.join(q.select("query_id", "requested", "series"), "query_id").withColumns({"tier": tier, "level": level}).where("tier IS NOT NULL")
    scoped = based.select("query_id", "tier", "level", F.explode("ids").alias("chunk_id"))
    no_base = (col("requested").isin("UNKNOWN_SCOPE", "GLOBAL_SCOPE")) | (wide & (col("family") == 0)) | (col("requested").isin("SERIES_SCOPE", "FAMILY_SCOPE") & (col("family") == 0))
    few = F.broadcast(chunks.select("chunk_id").orderBy("chunk_id").limit(2 * k))  # 2k rows
    everything = q.where(no_base).select("query_id", F.lit(1).alias("tier"), F.lit("GLOBAL_SCOPE").alias("level")).join(few)
    # Chunks with all identifiers: inside the base tiers by their own identity, as the tiers' lists of ids are cut.
    own = normalized(chunks, "chunk_id").withColumn("identity", F.struct(*FIELDS))
    marked = full.join(own.select("chunk_id", "identity"), "chunk_id").join(based.select("query_id", "identity", F.lit(True).alias("inside")), ["query_id", "identity"], "left")
    marked = marked.join(q.select("query_id", no_base.alias("free")), "query_id").withColumn("inside", F.coalesce(col("inside"), col("free")))
    marked = marked.withColumn("any", F.max(col("inside").cast("int")).over(W.partitionBy("query_id"))).where((col("any") == 0) | col("inside"))
    first = marked.select("query_id", F.lit(0).alias("tier"), F.lit("IDENTIFIER_SCOPE").alias("level"), "chunk_id")
    once = first.unionByName(scoped).unionByName(everything).groupBy("query_id", "chunk_id").agg(F.min(F.struct("tier", "level")).alias("t"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("t.tier", "chunk_id"))
    filled = once.withColumn("rank", rank).where(col("rank") <= k).select("query_id", "rank", "chunk_id", "t.level", "t.tier")
    return q.select("query_id", "requested", "exact", "series", "family", "everything", "identified"), filled


def mentioned(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, manufacturer, family, series, model): the distinct products of ``chunks`` that a question (query_id, text) names.

    A term of a product counts if it has three characters or more and a digit, or is written like ``aBc``. It is
    named if it stands in the question as it is, or if a word of the question (three characters or more, not a
    generic one) begins it and is at least half as long; then, if the term has numbers, all numbers of the question must be among them.
    """
    col = F.col
    normal_q = normal(col("text"))
    q = questions.select("query_id", normal_q.alias("said"), F.array_distinct(F.regexp_extract_all(normal_q, F.lit("[0-9]+"), F.lit(0))).alias("numbers"), F.array_distinct(F.regexp_extract_all(normal_q, F.lit("[a-z0-9]+"), F.lit(0))).alias("runs"))
    terms = F.concat(F.array("model", "series", "family"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = chunks.select(*FIELDS[:-1], F.explode(F.array_distinct(F.filter(terms, lambda t: F.coalesce(t, F.lit("")) != ""))).alias("term")).distinct()
    base = normal(col("term"))
    forms = F.array_distinct(F.array(base, F.regexp_replace(base, r"(?:-|\s*)series$", "")))
    kept = F.filter(forms, lambda v: (F.length(v) >= 3) & (v.rlike("[0-9]") | col("term").rlike("^[a-z][a-z0-9]*[A-Z]")))
    names = each.select(*(normal(col(c)).alias(c) for c in FIELDS[:-1]), F.explode(kept).alias("form")).distinct()
    form = names.select("form").distinct()
    # As it is: the form's longest run is a run of the question; then the whole form is looked for.
    runs = F.regexp_extract_all("form", F.lit("[a-z0-9]+"), F.lit(0))
    longest = F.element_at(F.array_sort(F.transform(runs, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r")))), 1)["r"]
    whole = form.withColumn("run", longest).join(q.select("query_id", "said", F.explode("runs").alias("run")), "run")
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    exact = whole.where(_stands(padded(col("said")), col("form"))).select("query_id", "form")
    # Cut short: a word of the question is a prefix, of half the length or more, of the form.
    prefix = F.explode(F.transform(F.sequence(F.greatest(F.lit(3), F.floor(F.length("form") / 2).cast("int")), F.length("form")), lambda n: F.substring(col("form"), F.lit(1), n)))
    long = form.withColumn("run", prefix).withColumn("own", F.array_distinct(F.regexp_extract_all("form", F.lit("[0-9]+"), F.lit(0))))
    said = q.select("query_id", "numbers", F.explode("runs").alias("run")).where((F.length("run") >= 3) & ~col("run").isin(*GENERIC))
    short = said.join(long, "run").where((F.size("own") == 0) | (F.size(F.array_except("numbers", "own")) == 0)).select("query_id", "form")
    return exact.union(short).distinct().join(names, "form").select("query_id", *FIELDS[:-1]).distinct()


def _stands(text: Column, form: Column) -> Column:
    """Whether ``form`` stands in ``text`` with no letter or digit right before or after it."""
    parts = F.split(text, F.concat(F.lit(r"(?<![a-z0-9])\Q"), form, F.lit(r"\E(?![a-z0-9])")), -1)
    return F.size(parts) > 1
