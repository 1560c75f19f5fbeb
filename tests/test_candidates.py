"""Queries on candidates: whatever Spark estimates, chunks are never sent whole, and a question that many ask is met once."""

from __future__ import annotations

import os

import pytest

from tessera.operators import candidates
from tessera.plans import catalogue

from .compare import of_duck, of_spark

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [
    "preservation_class",
    "aligned_view",
    "claim_binding",
    "evidence_ladder",
    "evidence_reason_hist",
    "four_part_binding",
    "answer_context",
    "support_gate",
    "typed_coverage_relation",
]


@pytest.mark.parametrize("name", NAMES)
def test_nothing_is_sent_by_an_estimate(spark, monkeypatch, name):
    monkeypatch.setattr(candidates, "SENT", 0)
    df = catalogue.queries()[name](spark, FOLDER)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert of_spark(df) == of_duck(FOLDER, catalogue.oracle_sql()[name])


def test_equal_questions_are_met_once(spark):
    chunks = spark.createDataFrame([(i, ["red", "bolt", "wear"] if i % 2 else ["red", "rod"]) for i in range(6)], "chunk_id long, tokens array<string>")
    questions = spark.createDataFrame([(1, list(range(1, 1000)), ["red", "bolt", "a1"][:2])], "ask long, asks array<long>, tokens array<string>")
    found = candidates.hits(chunks, questions)
    assert sorted((r["chunk_id"], r["n"]) for r in found.select("c.chunk_id", "n").collect()) == [(1, 2), (3, 2), (5, 2)]
