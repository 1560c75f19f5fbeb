"""Candidates of questions: chunks with one of the names that a question asks for, or else with both of its two rarest tokens.

Equal questions are asked once and carry the ids of all that ask them, so the work grows with the distinct questions;
pairs of askers and chunks are made at the very end, by those that return them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import settled

#: Up to so many rows of questions are sent to the chunks, after they are counted; more are joined by a shuffle.
SENT = 50_000


def met(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few`` (a settled table), which is sent to the tasks if it is small by count, never by an estimate."""
    return rows.join(F.broadcast(few) if few.count() <= SENT else few.hint("merge"), on, how)


def keys(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(ask, token, other, names): what finds the candidates of each question.

    ``questions`` has ask and tokens, ``chunks`` tokens, both distinct. A question with names (tokens with a digit) has a
    row for each; any other has one with the two tokens that the fewest chunks have, if chunks have two of them.
    """
    spelled = questions.select("ask", "tokens", F.filter("tokens", lambda t: t.rlike("[0-9]")).alias("names"))
    named = spelled.where(F.size("names") > 0).select("ask", F.explode("names").alias("token"), F.lit(None).cast("string").alias("other"), "names")
    plain = settled(spelled.where(F.size("names") == 0).select("ask", F.explode("tokens").alias("token")))
    asked = settled(plain.select("token").distinct())
    # explode_outer(): for explode() Catalyst would filter by the array's size first and so tokenise twice.
    df = met(chunks.select(F.explode_outer("tokens").alias("token")), asked, ["token"], "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    rarest = plain.join(df.hint("merge"), "token").groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("x")).where(F.size("x") >= 2)
    two = rarest.select("ask", F.col("x")[0]["token"].alias("token"), F.col("x")[1]["token"].alias("other"), F.lit(None).cast("array<string>").alias("names"))
    return settled(named.union(two))


def hits(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Each distinct question (columns of ``questions`` as a.) with each of its candidates (columns of ``chunks`` as c.), and n, their tokens in common.

    ``chunks`` has chunk_id and tokens, ``questions`` ask and tokens, both distinct and written where that saves work.
    """
    found = keys(chunks, questions)
    wide = found.join(questions.hint("merge"), "ask")
    cut = chunks.withColumn("token", F.explode_outer("tokens"))
    if found.count() <= SENT:
        met_ = cut.alias("c").join(F.broadcast(wide.alias("a")), F.expr("c.token = a.token"))
    else:
        pairs = cut.select("token", "chunk_id").join(found.select("token", "ask").hint("merge"), "token")
        at = chunks.join(pairs.withColumnRenamed("ask", "of").hint("merge"), "chunk_id")
        met_ = at.alias("c").join(wide.alias("a").hint("merge"), F.expr("c.of = a.ask AND c.token = a.token"))
    # A chunk with several names of a question counts once, by the first of them.
    kept = met_.where("CASE WHEN a.names IS NULL THEN array_contains(c.tokens, a.other) ELSE filter(a.names, x -> array_contains(c.tokens, x))[0] = a.token END")
    return kept.withColumn("n", F.size(F.array_intersect("c.tokens", "a.tokens")).cast("long"))
