"""Every operator on the awkward rows and on an empty table: the rows it must give, and nothing that crashes."""

from __future__ import annotations

import pytest

from tessera.llm import line_dedup, lm_score, media_columns, near_dup, pieces, quality_model, quality_rules, registry, secret_scan, source_mix, substring_dedup, toxicity
from tessera.llm.batches import per_text
from tessera.llm.shared import documents

from .conftest import prose

PLAIN = {
    "substring": substring_dedup.repeats,
    "mix": source_mix.plan,
    "lm": lm_score.scores,
    "rules": quality_rules.assess,
    "media": lambda d: per_text(documents(d), media_columns.features, media_columns.SCHEMA),
    "pieces": pieces.digests,
    "secrets": secret_scan.scans,
    "near": near_dup.classes,
    "lines": line_dedup.dedup,
}


@pytest.mark.parametrize("name", PLAIN)
def test_a_row_for_each_row(edge, nothing, name):
    found = PLAIN[name](edge).collect()
    assert sorted((r["doc_id"] for r in found), key=str) == sorted((r["doc_id"] for r in edge.select("doc_id").collect()), key=str)
    assert PLAIN[name](nothing).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_classifiers(edge, nothing, labels, spark, module):
    found = module.scores(edge, module.learn(edge, labels)).collect()
    assert len(found) == edge.count() and all(0 <= r["score"] <= 1 for r in found)
    assert module.scores(nothing, module.learn(nothing, labels)).count() == 0
    unlabelled = labels.where("doc_id < 0")
    assert {round(r["score"], 6) for r in module.scores(edge, module.learn(edge, unlabelled)).collect()} == {0.5}


#: Names that the operators use themselves or that need quoting.
CLASHING = ["t", "w", "n", "lines", "h", "k", "twice", "kept", "base_failed", "n_words", "repeat_limit", "upper", "rate", "row", "own", "nth", "of", "hidden", "__n", "__text", "a b", "a.b", "a`b"]


@pytest.mark.parametrize("stage", [quality_rules.keep_good, near_dup.keep_one, secret_scan.redact, source_mix.mix])
def test_stages_keep_the_columns_and_values(edge, nothing, spark, stage):
    out = stage(edge)
    assert out.columns == edge.columns
    assert stage(nothing).count() == 0
    left = {(r["doc_id"], r["text"]): r for r in edge.collect()}
    for r in out.collect():
        assert tuple(r)[5:] == tuple(left[r["doc_id"], r["text"]])[5:]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHING)
    data = [(i, prose(i, 70), "en", "s", *(f"{c}{i}" for c in CLASHING)) for i in range(12)]
    wide = spark.createDataFrame(data, schema)
    got = stage(wide)
    assert got.columns == wide.columns
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) >= 12 and set(rows) == set(data)


def test_registry_names():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, len(names) + 1))
    assert set(registry.oracle_sql()) <= set(names)


def test_empty_values(edge):
    by_text = {r["doc_id"]: r for r in secret_scan.scans(edge).collect() if r["doc_id"]}
    assert by_text[1]["spans"] == "" and by_text[2]["n_hex"] == 0
    lm = {r["doc_id"]: r for r in lm_score.scores(edge).collect()}
    assert lm[1]["n_tokens"] == lm[2]["n_tokens"] == lm[3]["n_tokens"] == 1
    one = near_dup.keep_one(edge).collect()
    assert sum(r["text"] is None or not r["text"].strip() for r in one) == 1
