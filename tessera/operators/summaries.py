"""Topics and summaries of text, and summaries of whole collections by levels of batches.

A collection is reduced as a tree: sentences are packed into batches in order, each batch
keeps its weightiest sentences up to a budget, and what is kept is packed again, until a
collection fits in one batch. Every sentence keeps its document and place, so the result
cites what it says. Batches come from running totals (``scan``): a collection that holds most
documents is many batches in many tasks from the start.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.scan import blocked, running
from tessera.session import settled

#: Characters of a batch, and those that it keeps.
BATCH, KEPT = 24_000, 2_400

# How a question names its topic, marks of summaries, labels with one spelling, technical terms, ends of sentences.
TOPICS = (r"^什么是(.+)$", r"^(.+?)是什么$", r"^(.+?)(?:包括|包含|由)哪些(?:阶段|环节|部分|内容).*$", r"^请(?:介绍|说明|解释)(.+)$")
MARKS = r"(?:用户问题|讨论主题|当前讨论主题)\s*[:：]"
ASKED = r"(?:用户问题|问题)\s*[:：]\s*(.+)"
DISCUSSED = r"(?:讨论主题|当前讨论主题)\s*[:：]\s*(.+?)(?=\s+用户问题\s*[:：]|[。；\n]|$)"
LABELS = ((r"(?i)PLC\s*的\s*扫描周期", "PLC 扫描周期"), (r"(?i)^PID\s*控制$", "PID 控制器"))
BARE = (r"(?i)PID\s*控制(?:器)?", r"(?i)PLC\s*的?扫描周期")
TERMS = (r"\bPID\b", r"\bPLC\b", r"积分(?:项|环节|作用|饱和)?", r"微分(?:项|环节|作用)?", r"比例(?:项|环节|作用)?", r"扫描周期", r"输入响应(?:速度)?", r"稳态误差", r"反馈控制", r"闭环系统")
SENTENCE = r"[^.!?。！？\n]+[.!?。！？]*"
NO_TOPIC = "较早对话未提取到可靠主题。"


def plain(text: Column) -> Column:
    """Text with single spaces and none at its ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def _first(values: list[Column]) -> Column:
    """The first that is not empty, else the empty text."""
    return F.coalesce(*(F.when(v != "", v) for v in values), F.lit(""))


def _named(question: Column) -> Column:
    return _first([F.regexp_extract(question, p, 1) for p in TOPICS])


def label(topic: Column) -> Column:
    """A topic as a label: one spelling of known ones, 120 characters at most."""
    bare = F.regexp_replace(plain(topic), "^[？?。 ]+|[？?。 ]+$", "")
    return F.trim(F.substring(reduce(lambda t, r: F.regexp_replace(t, *r), LABELS, bare), 1, 120))


def topic(text: Column) -> Column:
    """The topic of a question or of a summary: by the question's form, else by the last question or the topic that a summary names, else by known words."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "^[？?。 ]+|[？?。 ]+$", "")
    questions = F.reverse(F.split(F.regexp_extract(bare, ASKED, 1), "[；\n]"))
    named = F.filter(F.transform(questions, lambda q: _named(F.regexp_replace(q, "^[？?。 ]+|[？?。 ]+$", ""))), lambda t: t != "")
    return label(_first([F.when(~bare.rlike(MARKS), _named(bare)).otherwise(""), F.coalesce(F.get(named, F.lit(0)), F.lit("")), F.regexp_extract(bare, DISCUSSED, 1), *(F.regexp_extract(bare, p, 0) for p in BARE)]))


def turn_summaries(turns: DataFrame, most: int = 2000) -> DataFrame:
    """(conv_id, summary) of ``turns`` (conv_id, turn, role, text): up to six technical terms, in the order of TERMS, and the last three questions of the user.

    A conversation's text is one value. Without both there is a fixed sentence.
    """
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    all_ = turns.groupBy("conv_id").agg(rows.alias("rows"))
    said = F.array_join(F.transform("rows", lambda r: r["text"]), " ")
    asked = F.transform(F.filter("rows", lambda r: r["role"] == "user"), lambda r: r["text"])
    terms = F.array_distinct(F.filter(F.array(*(F.regexp_extract(said, f"(?i){p}", 0) for p in TERMS)), lambda t: t != ""))
    last = F.slice(asked, F.greatest(F.lit(1), F.size(asked) - 2), F.lit(3))
    parts = F.array_compact(F.array(
        F.when(F.size(terms) > 0, F.concat(F.lit("讨论主题："), F.array_join(F.slice(terms, 1, 6), "、"))), F.when(F.size(asked) > 0, F.concat(F.lit("用户问题："), F.array_join(last, "；"))),
    ))
    return all_.select("conv_id", F.rtrim(F.substring(plain(F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(NO_TOPIC)), 1, most)).alias("summary"))


def sentences(docs: DataFrame) -> DataFrame:
    """(collection, doc, pos, sentence, size, weight) of ``docs`` (collection, doc, text): a sentence weighs its number of distinct words."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SENTENCE), F.lit(0))
    each = docs.select("collection", "doc", F.posexplode(found).alias("pos", "raw")).withColumn("sentence", F.trim("raw")).where("sentence <> ''")
    return each.select("collection", "doc", "pos", "sentence", F.length("sentence").cast("long").alias("size"), F.size(F.array_distinct(F.split("sentence", " +"))).alias("weight"))


def tree_summary(rows: DataFrame, batch: int = BATCH, kept: int = KEPT, blocks: int | None = None) -> DataFrame:
    """(collection, nth, doc, pos, sentence, levels): what is left of ``sentences`` when each collection fits in one batch and has been cut to ``kept`` characters.

    A level's batch is the whole number of ``batch`` in the characters before a sentence;
    a batch keeps its sentences by weight, then by place, as long as all so far fit in ``kept``
    (the weightiest always). Each level divides what is left by about batch / kept, so levels
    grow with the logarithm; each ends in a written table, and only their number is known to the driver.
    (doc, pos) must be unique within a collection.
    """
    order, by_place = ["doc", "pos"], ["collection"]
    level, done = 0, None
    while True:
        total = running(blocked(rows, by_place, order, blocks), by_place, order, total={"before": F.col("size")}, before=True)
        batched = total.withColumn("batch", F.floor(F.col("before") / batch)).drop("block_of_scan", "before")
        per = W.partitionBy("collection", "batch")
        ranked = per.orderBy(F.desc("weight"), *order)
        used = F.sum("size").over(ranked.rowsBetween(W.unboundedPreceding, 0))
        cut = batched.withColumns({"used": used, "nth": F.row_number().over(ranked)}).where((F.col("used") <= kept) | (F.col("nth") == 1))
        level += 1
        ends = batched.groupBy("collection").agg(F.max("batch").alias("last"))
        left = settled(cut.join(ends, "collection").withColumn("levels", F.lit(level)))
        final = left.where("last = 0").select("collection", "nth", "doc", "pos", "sentence", "levels")
        done = final if done is None else done.union(final)
        rows = left.where("last > 0").select("collection", "doc", "pos", "sentence", "size", "weight")
        if rows.isEmpty():
            return done
