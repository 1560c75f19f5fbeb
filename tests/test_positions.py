"""Positions against loops over all pairs of mentions."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessera.operators import positions as ps

ALIASES = {"voltage": ("voltage", "rated v"), "speed": ("speed",), "torque": ("torque", "aa"), "cause": ("cause",)}


def together(ids, attributes, text):
    text = " ".join(text.lower().split())
    targets = [m.start() for i in ids for m in re.finditer(re.escape(i.lower()), text)]
    targets += [k for i in ids for k in range(len(text)) if text.startswith(i.lower(), k)]
    if not targets:
        return None
    strong = [a for a in attributes or [] if a not in ps.LOOSE]
    others = [m.start() for m in re.finditer(ps.OTHER, text) if all(abs(m.start() - t) > 1 for t in targets)]
    words = [k for a in strong for w in ALIASES[a] for k in range(len(text)) if text.startswith(w, k)]
    return not strong or not words or any(not any(min(t, w) < o < max(t, w) for o in others) for t in targets for w in words)


def test_together_is_no_other_between(spark):
    r = random.Random(2)
    say = ["P12", "p123", "12.5", "F0001", "F 1", "voltage", "Rated  V", "speed", "torque", "aaa", "word", "\n", "x9", "cause", "a77", "7.1.2"]
    texts = [(d, r.choice([" ", " ", ""]).join(r.choice(say) for _ in range(r.randint(0, 14)))) for d in range(250)] + [(900, None), (901, "")]
    questions = [(q, r.sample(["P12", "12.5", "f0001", "a77", "x9"], r.randint(1, 2)), r.choice([None, [], ["cause"], ["voltage"], ["speed", "torque"], ["torque", "cause"]])) for q in range(40)]
    got = ps.associated(spark.createDataFrame(texts, "doc int, text string").repartition(3), spark.createDataFrame(questions, "question int, identifiers array<string>, attributes array<string>"), ALIASES)
    want = {(q, d): t for q, ids, a in questions for d, text in texts if (t := together(ids, a, text or "")) is not None}
    assert {(x["question"], x["doc"]): x["together"] for x in got.collect()} == want
    assert len(set(want.values())) == 2 and sum(not v for v in want.values()) > 50


def test_anchors(spark):
    claims = [(1, "P12 Ramp", "time\nP13"), (2, None, "p12. Ramp"), (3, "", "Set p12 now"), (4, "Ramp", "Related parameter: P12"), (5, "xp12", "P123"), (6, "P13", None), (7, "Ramp", "first\nP12")]
    df = spark.createDataFrame(claims, "claim int, subsection string, text string")
    questions = spark.createDataFrame([(1, ["P12"]), (2, ["p13", "zz"])], "question int, identifiers array<string>")
    assert {tuple(x) for x in ps.anchored(df, questions).collect()} == {(1, 1), (1, 3), (2, 6)}


def test_columns_of_two_models(spark):
    head = "technical data el1001 el2002\n"
    rows = [
        ("el1001", ["24 v"], head + "rated voltage 24 v 48 v", False), ("el2002", ["24 v"], head + "rated voltage 24 v 48 v", True), ("el2002", ["48 v"], head + "rated voltage 24 v 48 v", False),
        ("el3003", ["24 v"], head + "rated voltage 24 v 48 v", True), ("", ["24 v"], head + "voltage 24 v 48 v", False), ("el1001", [], head + "voltage 1 v 2 v", False), ("el1001", ["24 v"], "voltage 24 v 48 v", False),
        ("el1001", ["4 v"], head + "voltage 24 v 48 v", True), ("el1001", ["24 v"], head + "voltage 24 v", False), ("el1001", ["24 v"], head + "current 24 ma 1 ma", False), ("el1001", ["24 v", "2 a"], head + "voltage 24 v 48 v", True),
    ]
    df = spark.createDataFrame(rows, "model string, vals array<string>, text string, want boolean")
    got = df.select(ps.column_conflict(F.col("model"), F.array(F.lit("voltage")), F.col("vals"), F.col("text")).alias("x")).collect()
    assert [g["x"] for g in got] == [r[3] for r in rows]


def test_equal_questions_are_asked_once(spark, monkeypatch):
    r = random.Random(5)
    texts = [(d, " ".join(r.choice(["p12", "x9", "a77", "speed", "aa", "word"]) for _ in range(9))) for d in range(60)]
    kinds = [(["P12"], ["speed"]), (["x9", "p12"], ["torque", "speed"]), (["p12", "X9"], ["speed", "torque"])]
    questions = [(q, *kinds[q % 3]) for q in range(90)]
    found = []
    monkeypatch.setattr(ps, "settled", lambda df: found.append(df) or df)
    for sent in (ps.SENT, 0):
        monkeypatch.setattr(ps, "SENT", sent)
        got = ps.associated(spark.createDataFrame(texts, "doc int, text string"), spark.createDataFrame(questions, "question int, identifiers array<string>, attributes array<string>"), ALIASES)
        want = {(q, d): t for q, ids, a in questions for d, text in texts if (t := together(ids, a, text)) is not None}
        assert {(x["question"], x["doc"]): x["together"] for x in got.collect()} == want
    asked, mentioned = found[0], found[1]
    assert asked.count() == 2 and {x["doc"] for x in mentioned.select("doc").distinct().collect()} == {d for _, d in want}
