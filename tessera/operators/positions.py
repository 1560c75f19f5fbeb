"""Where things stand in a text: identifiers and the attributes that belong to them.

Mentions are postings: document, position, kind. A question's identifier and attribute
belong together in a document if no other identifier stands between two of their mentions. The
other identifiers cut the text into segments; both belong together if a segment has both, which is an equality of
segment numbers, so no mention meets another one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.candidates import SENT, met
from tessera.session import settled

# Other identifiers, attributes that need not stand near, marks of a list of other parameters, the head of a table of two models, cells with units.
OTHER = r"(?<![a-z0-9])(?:\d{1,2}\.\d{1,2}|[a-z]\d{2,5})(?![a-z0-9])"
LOOSE = ("requirements", "cause", "status", "quantity")
RELATED = r"(?i)\brelated\s+parameters?\s*:"
TWO_MODELS = r"technical data\s+(el\d{4})\s+(el\d{4})"
CELL = r"\d+(?:\.\d+)?\s*(?:us|ms|ma|vdc|v|mm2|mm|m|g|bytes?|bits?|%)"


def technical(text: Column) -> Column:
    """Lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def mentions(texts: DataFrame, words: list[str], lengths: list[int], only: frozenset[str] | None = None) -> DataFrame:
    """(doc, kind, value, pos) of ``texts`` (doc, text): other identifiers (kind o), the given ``words`` (kind w) and parts of runs (kind r).

    A run is what [a-z0-9.] matches, with a digit; its parts are those of the given
    ``lengths`` that have a digit. Words are a vocabulary and lengths those of identifiers: both are
    small whatever the table. Positions are characters of the text in ``technical`` form; matches of a word may overlap. With ``only`` (identifiers),
    parts are those and texts without any of them have no rows.
    """
    word = {w: re.compile(f"(?={re.escape(w)})") for w in words}
    other, run = re.compile(OTHER), re.compile(r"[a-z0-9.]*[0-9][a-z0-9.]*")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                held = len(out)
                for m in run.finditer(text):
                    parts = ((m[0][s : s + n], m.start() + s) for n in lengths for s in range(len(m[0]) - n + 1))
                    out += [(i, "r", part, at) for part, at in parts if (any(c.isdigit() for c in part) if only is None else part in only)]
                if only is not None and len(out) == held:
                    continue
                out += [(i, "o", m[0], m.start()) for m in other.finditer(text)]
                out += [(i, "w", w, m.start()) for w, p in word.items() for m in p.finditer(text)]
            rows, kind, value, pos = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array(pos, pa.int64())], names=["doc", "kind", "value", "pos"])

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.select("doc", technical(F.col("text")).alias("text")).mapInArrow(find, f"doc {kind}, kind string, value string, pos long")


def associated(texts: DataFrame, questions: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """(question, doc, together) for each question and each document that has one of its identifiers.

    ``questions`` has question, identifiers (with a digit, of letters, digits and points) and attributes
    (keys of ``aliases``). Together is true if one of the identifiers and one of the attributes' words stand with no other
    identifier between them; also if the question has no attribute that must stand near, or the document none of their words.
    Another identifier within one character of a mention of the question's own is that mention. Questions that ask for the same are asked once, by
    the first of them, and their rows made at the end.
    """
    col = F.col
    whole = questions.select("question", F.coalesce(F.transform("identifiers", technical), F.array().cast("array<string>")).alias("identifiers"), F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes"))
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    same = whole.groupBy("question").agg(merged("identifiers"), merged("attributes")).groupBy("identifiers", "attributes").agg(F.array_sort(F.collect_list("question")).alias("askers"))
    asked = settled(same.withColumn("question", F.element_at("askers", 1)))
    wanted = asked.select("question", F.explode(F.array_distinct("identifiers")).alias("value")).where(col("value").rlike("^[a-z0-9.]*[0-9][a-z0-9.]*$"))
    lengths = sorted(r["n"] for r in wanted.select(F.length("value").alias("n")).distinct().collect())  # a few numbers
    vocabulary = sorted({w for k, ws in aliases.items() if k not in LOOSE for w in ws if w})
    pairs = [(k, w) for k, ws in aliases.items() if k not in LOOSE for w in ws if w]
    values = [r["value"] for r in wanted.select("value").distinct().limit(SENT + 1).collect()]
    few = len(values) <= SENT
    found = settled(mentions(texts, vocabulary, lengths, frozenset(values))) if few else mentions(texts, vocabulary, lengths)
    target = found.where("kind = 'r'").select("doc", "value", "pos").join(wanted.hint("merge"), "value").select("question", "doc", "pos").distinct()
    near = target.select("question", "doc", F.explode(F.array(col("pos") - 1, col("pos"), col("pos") + 1)).alias("pos")).distinct()
    held = target.select("question", "doc").distinct()
    other = found.where("kind = 'o'").select("doc", "pos").join(held, "doc").join(near, ["question", "doc", "pos"], "left_anti").select("question", "doc", "pos")
    spark = texts.sparkSession
    words = F.broadcast(spark.createDataFrame(pairs or [("", "")], "attribute string, value string"))  # the vocabulary
    strong = asked.select("question", F.explode("attributes").alias("attribute")).where(~col("attribute").isin(*LOOSE)).distinct()
    near_words = found.where("kind = 'w'").select("doc", "value", "pos").join(words, "value").join(strong, "attribute").join(held, ["question", "doc"]).select("question", "doc", "pos").distinct()
    events = target.withColumn("k", F.lit("t")).union(other.withColumn("k", F.lit("o"))).union(near_words.withColumn("k", F.lit("w")))
    order = W.partitionBy("question", "doc").orderBy("pos")
    cut = (col("k") == "o").cast("long")
    numbered = events.withColumns({"below": F.coalesce(F.sum(cut).over(order.rangeBetween(W.unboundedPreceding, -1)), F.lit(0)), "upto": F.sum(cut).over(order.rangeBetween(W.unboundedPreceding, 0))}).where("k <> 'o'")
    segments = numbered.select("question", "doc", "k", F.explode(F.when(col("k") == "t", F.array("below")).otherwise(F.array_distinct(F.array("below", "upto")))).alias("segment"))
    both = segments.groupBy("question", "doc", "segment").agg(F.max((col("k") == "t").cast("int")).alias("t"), F.max((col("k") == "w").cast("int")).alias("w"))
    per_doc = both.groupBy("question", "doc").agg((F.max(col("t") * col("w")) == 1).alias("close"), (F.max("w") == 0).alias("wordless"))
    decided = per_doc.join(strong.select("question").distinct().withColumn("strong", F.lit(True)).hint("merge"), "question", "left").select("question", "doc", (col("strong").isNull() | col("wordless") | col("close")).alias("together"))
    return met(decided, asked.select("question", "askers"), ["question"]).select(F.explode("askers").alias("question"), "doc", "together")


def anchored(claims: DataFrame, questions: DataFrame) -> DataFrame:
    """(question, claim): claims whose subsection or first line names an identifier of the question, before any list of related parameters.

    ``claims`` has claim, subsection and text. The identifier must stand alone. Claims and questions meet by equal words.
    """
    first = F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1)
    scope = F.element_at(F.split(technical(F.concat(F.coalesce("subsection", F.lit("")), F.lit(" "), first)), RELATED), 1)
    words = F.explode(F.array_distinct(F.regexp_extract_all(scope, F.lit("[a-z0-9.]+"), F.lit(0)))).alias("word")
    asked = questions.select("question", F.explode(F.array_distinct(F.transform("identifiers", technical))).alias("word"))
    return claims.select("claim", words).join(asked, "word").select("question", "claim").distinct()


def column_conflict(model: Column, phrases: Column, values: Column, window: Column) -> Column:
    """Whether a value lies in the other column of a table of two models.

    ``window`` is lower-case text whose head names the models. The first line with one of the phrases is the row; if it
    has a cell for each model, all values must stand in the model's own. A model that the head does not name conflicts.
    """
    models = F.array(F.regexp_extract(window, TWO_MODELS, 1), F.regexp_extract(window, TWO_MODELS, 2))
    row = F.get(F.filter(F.split(window, "\n"), lambda line: F.exists(phrases, lambda p: F.contains(line, p))), F.lit(0))
    cells = F.regexp_extract_all(F.coalesce(row, F.lit("")), F.lit(CELL), F.lit(0))
    own = F.get(cells, F.array_position(models, model).cast("int") - 1)
    missing = F.exists(values, lambda v: ~stands(own, v))
    return (
        F.when((model == "") | (F.size(values) == 0) | ~window.rlike(TWO_MODELS), False).when(~F.array_contains(models, model), True)
        .when(row.isNull() | (row == "") | (F.size(cells) != 2), False).otherwise(missing)
    )


def stands(text: Column, value: Column) -> Column:
    """Whether ``value`` stands in ``text`` with no letter or digit right before or after it."""
    return F.size(F.split(text, F.concat(F.lit(r"(?<![a-z0-9])\Q"), value, F.lit(r"\E(?![a-z0-9])")), -1)) > 1
