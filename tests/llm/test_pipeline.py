"""The pipeline against the same stages done one text at a time."""

from __future__ import annotations

import random

import corpus_pipeline
from tessera.llm import pieces, quality_rules, secret_scan, source_mix
from tessera.llm.shared import table

from .conftest import prose


def test_run(spark, tmp_path):
    r = random.Random(1)
    data = [(i, prose(i % 90, 60 + i % 90), "en", f"s{i % 4}", 0) for i in range(150)]
    data += [(200 + i, prose(300 + i, 80) + f" token={r.randbytes(12).hex()}", "en", "s1", 0) for i in range(10)]
    data += [(300 + i, "bad " * 80, "en", "s2", 0) for i in range(5)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = table(spark, str(tmp_path), "documents")
    kept = {x["doc_id"] for x in quality_rules.assess(docs).where("kept").collect()}
    assert not kept & set(range(300, 305))
    seen, once = set(), []
    for i, t, *rest in sorted(data):
        if i in kept and t not in seen:
            seen.add(t)
            once.append((i, secret_scan.redacted(t)[0], *rest))
    times = {x["doc_id"]: x["copies"] for x in source_mix.plan(spark.createDataFrame(once, docs.schema)).collect()}
    model = pieces.load(pieces.model_path())
    expected = sorted((i, *model.digest(t)) for i, t, *_ in once for _ in range(times[i]))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == expected
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "secret_scans", "source_mix", "sentencepiece"]


def test_run_on_awkward_rows(spark, edge, nothing, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns go through all stages; an empty table gives no rows."""
    edge.write.parquet(f"{tmp_path}/edge/documents.parquet")
    nothing.write.parquet(f"{tmp_path}/nothing/documents.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/edge").collect()
    assert {r["doc_id"] for r in rows} <= {6, 7, 9, 10, None} and len(rows) == len([r for r in rows if r["n_tokens"] > 50])
    assert len({r["decoded_sha256"] for r in rows}) > 1
    assert corpus_pipeline.run(spark, f"{tmp_path}/nothing").collect() == []
