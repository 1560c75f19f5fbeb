"""Topics, conversation summaries and summaries of whole languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import summaries as sm
from tessera.plans.dialect import Book
from tessera.sources.tables import spread, table

book = Book()
QUERIES, ORACLES, COVERS = book.QUERIES, book.ORACLES, book.COVERS

TREE = f"""
WITH RECURSIVE found AS (SELECT lang AS collection, doc_id AS doc, regexp_extract_all(coalesce(text, ''), '{sm.SENTENCE}') AS s FROM documents),
each AS (SELECT collection, doc, unnest(range(len(s)))::BIGINT AS pos, trim(unnest(s)) AS sentence FROM found),
tree AS (
  SELECT collection, doc, pos, sentence, 0::BIGINT AS nth, 0 AS levels, 1::BIGINT AS last FROM each WHERE sentence <> ''
  UNION ALL
  SELECT collection, doc, pos, sentence, nth, levels + 1, last FROM (
    SELECT *, sum(length(sentence)) OVER (PARTITION BY collection, batch ORDER BY weight DESC, doc, pos ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY collection, batch ORDER BY weight DESC, doc, pos) AS nth, max(batch) OVER (PARTITION BY collection) AS last
    FROM (SELECT collection, doc, pos, sentence, levels, len(list_distinct(string_split_regex(sentence, ' +'))) AS weight, (coalesce(sum(length(sentence)) OVER (PARTITION BY collection ORDER BY doc, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {sm.BATCH})::BIGINT AS batch FROM tree WHERE last > 0)
  ) WHERE used <= {sm.KEPT} OR nth = 1)
SELECT collection, nth, doc, pos, sentence, levels FROM tree WHERE last = 0"""


@book.frame("CNV11", TREE)
def language_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences that stand for each language's documents, kept level by level, with document and place."""
    docs = spread(table(spark, folder, "documents")).select(F.col("lang").alias("collection"), F.col("doc_id").alias("doc"), "text")
    return sm.tree_summary(sm.sentences(docs)).withColumns({"nth": F.col("nth").cast("long"), "pos": F.col("pos").cast("long")})


_ASK = "CASE p_partkey % 6 WHEN 0 THEN concat('什么是', p_name, '？') WHEN 1 THEN concat(p_name, '是什么') WHEN 2 THEN concat('请介绍', p_name, '。') WHEN 3 THEN concat('讨论主题：', p_type, ' 用户问题：', '你好；', p_name, '包括哪些部分') WHEN 4 THEN concat('PID 控制', ' ', p_name) ELSE p_name END"
TOPIC = f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN 'PID 控制器' WHEN 5 THEN '' ELSE p_name END AS topic FROM part"""


@book.frame("CNV5 SUB89", TOPIC)
def part_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The topic of a question or summary about every part, in each of the forms that name one."""
    return table(spark, folder, "part").select("p_partkey", sm.topic(F.expr(_ASK)).alias("topic"))


TURNS = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, coalesce(text, '') DESC) AS r FROM conversations),
u AS (SELECT conv_id, text, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY r) AS k FROM t WHERE role = 'user'),
s AS (SELECT conv_id, string_agg(text, '；' ORDER BY turn, text) AS asked FROM u WHERE k <= 3 GROUP BY conv_id)
SELECT conv_id, rtrim(substr(trim(regexp_replace(coalesce('用户问题：' || asked, '{sm.NO_TOPIC}'), '\\s+', ' ', 'g')), 1, 2000)) AS summary FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN s USING (conv_id)"""


@book.frame("CNV3", TURNS)
def turn_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """The summary of every conversation: technical terms (none of this table's texts has any) and the last three questions."""
    return sm.turn_summaries(table(spark, folder, "conversations"), 2000)
