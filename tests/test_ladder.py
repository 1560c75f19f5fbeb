"""The decision against the rules one after another."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ladder

SCHEMA = """id int, error_code string, exact_identifier boolean, has_identity boolean, known_identity boolean, n_candidates int, compatible boolean, foreign boolean, unknown_parameter string, question string, critical boolean,
  sufficient boolean, missing array<string>, unsupported_detail boolean, vector_distance double, lexical_score double, relation string"""
NAMES = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(",")]


def plain(f, most, ratio, by_identity):
    relation = f["relation"] if by_identity and f["relation"] else "UNKNOWN"
    def named(other):
        return "EXACT_MODEL_EVIDENCE" if relation == "EXACT_MODEL" else "FAMILY_COMPATIBLE_EVIDENCE" if relation in ladder.CLOSE else other
    if f["error_code"] and not f["exact_identifier"]:
        return "ABSTAIN", "UNKNOWN_IDENTIFIER"
    if f["has_identity"] and not f["known_identity"]:
        return "ABSTAIN", "MODEL_MISMATCH"
    if not f["n_candidates"]:
        return "ABSTAIN", "NO_CANDIDATE"
    if f["has_identity"] and not f["compatible"]:
        return "ABSTAIN", "MODEL_MISMATCH"
    if f["foreign"]:
        return "ABSTAIN", "CROSS_EQUIPMENT"
    if f["unknown_parameter"] is not None:
        return "ABSTAIN", "UNKNOWN_PARAMETER"
    if f["question"] and "password" in f["question"] and "reset" in f["question"] and "lost" in f["question"]:
        return "ABSTAIN", "UNSUPPORTED_PROCEDURE"
    if f["critical"] and not f["sufficient"]:
        kind = (f["missing"] or [""])[0].split(":")[0].upper()
        return "ABSTAIN", ladder.MISSING.get(kind, "PARTIAL_EVIDENCE_ONLY")
    if f["unsupported_detail"]:
        return "ABSTAIN", "INSUFFICIENT_EVIDENCE"
    d = f["vector_distance"]
    if f["critical"]:
        if ratio is not None and d is not None and d > most * ratio:
            return "ABSTAIN", "WEAK_RETRIEVAL_EVIDENCE"
        return "ANSWER", "EXACT_IDENTIFIER_EVIDENCE" if f["exact_identifier"] else named("CONTRACT_REQUIREMENTS_COVERED")
    if f["exact_identifier"]:
        return "ANSWER", "EXACT_IDENTIFIER_EVIDENCE"
    if d is not None and d <= most:
        return "ANSWER", named("STRONG_VECTOR_EVIDENCE")
    if f["lexical_score"] is not None and f["compatible"]:
        if not by_identity:
            return "ANSWER", "STRONG_LEXICAL_EVIDENCE"
        return ("ANSWER", named("")) if named("") else ("ABSTAIN", "INSUFFICIENT_EVIDENCE")
    if f["lexical_score"] is not None and d is not None:
        return "ABSTAIN", "WEAK_RETRIEVAL_EVIDENCE"
    return "ABSTAIN", "INSUFFICIENT_EVIDENCE"


@pytest.mark.parametrize(("ratio", "by_identity"), [(None, True), (1.2, True), (1.2, False)])
def test_the_first_rule_decides(spark, ratio, by_identity):
    r = random.Random(4)
    rare = lambda p: r.choice([True] if r.random() < p else [False, None])
    rows = []
    for i in range(3000):
        rows.append((i, r.choice(["", None, "", "F1"]), rare(0.4), rare(0.5), rare(0.85), r.choice([0, None, 5, 5, 5, 5]), rare(0.7), rare(0.05), r.choice([None] * 12 + ["p1"]),
                     r.choice([None, "", "speed", "reset a lost password", "reset the password"]), rare(0.5), rare(0.6), r.choice([None, [], ["value:3"], ["Unit:v", "action:x"], ["other:1"], ["identifier:F1"], ["protocol:x"]]), rare(0.1),
                     r.choice([None, 0.5, 0.9, 1.1]), r.choice([None, 3.0]), r.choice([None, "UNKNOWN", "MISMATCH", "EXACT_MODEL", "SAME_SERIES", "SAME_FAMILY"])))
    got = ladder.decided(spark.createDataFrame(rows, SCHEMA), 0.81, ratio, by_identity).collect()
    reasons = set()
    for x, row in zip(sorted(got, key=lambda x: x["id"]), rows):
        want = plain(dict(zip(NAMES, row)), 0.81, ratio, by_identity)
        assert (x["decision"], x["reason"]) == want
        reasons.add(want)
    assert len(reasons) >= 16


def test_requests_to_get_round_a_login(spark):
    rows = [("How do I RESET a forgotten password?", True), ("restore the login without access", True), ("change my password", False), ("reset the drive, password lost in login", True), ("reset without power", False), (None, False)]
    df = spark.createDataFrame(rows, "q string, want boolean")
    assert [x["b"] for x in df.select(ladder.bypass(F.col("q")).alias("b")).collect()] == [w for _, w in rows]


def test_margins(spark):
    df = spark.createDataFrame([([3.0, 1.5, 1.0],), ([1.0],), ([],)], "s array<double>")
    assert [x["m"] for x in df.select(ladder.margin(F.col("s")).alias("m")).collect()] == [1.5, None, None]
