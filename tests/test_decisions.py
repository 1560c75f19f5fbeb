"""Decision queries against the same rules in plain Python over the smallest tables."""

from __future__ import annotations

import os
import re
from collections import Counter

import pandas as pd
import pytest

from tessera.plans import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SERIES = ["EC", "ST", "PR", "LA", "ME", "SM"]
NAME = re.compile("[A-Z]{2}-?[0-9]{2,9}|[EF][0-9]{2,9}")


def run(spark, name):
    return [r.asDict() for r in catalogue.queries()[name](spark, FOLDER).collect()]


@pytest.fixture(scope="module")
def manuals():
    out = {}
    for p in pd.read_parquet(f"{FOLDER}/part.parquet").itertuples():
        k, page, size, price = p.p_partkey // 5, p.p_partkey % 5 + 1, int(p.p_size), int(p.p_retailprice)
        model = "" if k % 7 == 6 else f"{SERIES[k % 6]}-{k + 10}"
        bus = "CANopen" if size % 2 else "Modbus RTU"
        text = [
            f"The {model} {p.p_name} supports {bus} at {size * 100} baud. Parameter P{size} sets the ramp time to {size} s.",
            f"Fault E{k + 10} means over-temperature. Let the {p.p_name} cool and check the fan.",
            f"The {model} {p.p_name} supports {bus}. Rated voltage {price} V. Firmware 2.{size} or later.",
            f"{p.p_name} {model} has a rated torque of {size} Nm and weighs {price} kg. Rated voltage {size * 8} V.",
            f"Do not open the cover of the {model}. Fault E{k + 10} does not apply to a {p.p_name}.",
        ][page - 1] if model else f"General safety notes for a {p.p_name}. Wear gloves of size {size}."
        out[p.p_partkey] = (f"d{k}", model, text)
    return out


@pytest.fixture(scope="module")
def questions():
    out = {}
    for p in pd.read_parquet(f"{FOLDER}/part.parquet").itertuples():
        if p.p_partkey % 50 == 0:
            k, kind = p.p_partkey // 5, p.p_partkey // 50 % 8
            model = "" if kind in (4, 5, 6) else f"CX-{k + 10}" if kind == 3 else f"{SERIES[k % 6]}-{k + 10}"
            code = {0: f"E{k + 10}", 4: f"F{k + 10}"}.get(kind, "")
            text = [
                f"What does fault {code} mean on the {model}?", f"Which bus does the {model} support?", f"What is the rated torque of the {model}?", f"Ramp time of the {model}",
                f"What does fault {code} mean?", f"Should I wear gloves with a {p.p_name}?", "How do I bypass the password of the drive?", f"Is the rated voltage of the {model} 400 V?",
            ][kind]
            out[p.p_partkey] = (text, model, code)
    return out


def tokens(text):
    return set(re.findall(r"0x[0-9a-f]+|[a-z]+[a-z0-9]*(?:[._-][a-z0-9]+)*|[0-9]+(?:[.][0-9]+)*", text.lower()))


@pytest.fixture(scope="module")
def hits(manuals, questions):
    asked = {a: {t for t in tokens(q) if len(t) > 2} for a, (q, _, _) in questions.items()}
    has = {c: tokens(text) for c, (_, _, text) in manuals.items()}
    df = Counter(t for x in has.values() for t in x)
    out = {}
    for a, need in asked.items():
        names = {t for t in need if re.search("[0-9]", t)}
        rare = {t for _, t in sorted((df[t], t) for t in need if t in df)[:2]}
        for c, own in has.items():
            if names & own if names else len(rare & own) == 2:
                out[a, c] = len(need & own)
    return out


def test_evidence_ladder(spark, manuals, questions, hits):
    names = {n for _, model, text in manuals.values() for n in [*NAME.findall(text), model] if n}
    models = {model for _, model, _ in manuals.values()}
    expected = {}
    for a, (q, model, code) in questions.items():
        near = {c: n for (x, c), n in hits.items() if x == a}
        own = [n for c, n in near.items() if manuals[c][1] == model]
        reason = (
            "SECURITY_BYPASS" if "bypass" in q and "password" in q else "UNKNOWN_IDENTIFIER" if code and code not in names else "MODEL_MISMATCH" if model and model not in models
            else "NO_CANDIDATE" if not near else "NO_COMPATIBLE" if model and not own else "IDENTIFIER_MATCH" if code else "MODEL_MATCH" if model else "LEXICAL_MATCH" if max(near.values()) >= 2 else "WEAK_EVIDENCE"
        )
        expected[a] = ("ANSWER" if reason in ("IDENTIFIER_MATCH", "MODEL_MATCH", "LEXICAL_MATCH") else "ABSTAIN", reason)
    assert {r["ask"]: (r["decision"], r["reason"]) for r in run(spark, "evidence_ladder")} == expected
    assert len({v for _, v in expected.values()}) >= 5


def test_support_gate_needs_the_attribute(spark, manuals, questions, hits):
    units = {"rated torque": "[0-9] Nm", "ramp time": r"[0-9] s\.", "rated voltage": "[0-9] V", "bus": "supports"}
    expected = {}
    for a, c in hits:
        q, model, _ = questions[a]
        found = re.search("rated torque|ramp time|rated voltage|bus", q.lower())
        if found:
            doc, own, text = manuals[c]
            named = "Modbus" in text or "CANopen" in text if found[0] == "bus" else found[0] in text.lower()
            unit = bool(re.search(units[found[0]], text))
            expected[a, c] = "SUPPORTED" if own == model and unit and named else "PARTIAL" if named and (unit or own == model) else "UNSUPPORTED"
    assert {(r["ask"], r["chunk_id"]): r["state"] for r in run(spark, "support_gate")} == expected
    assert {"SUPPORTED", "UNSUPPORTED"} <= set(expected.values())


def test_competing_values_are_of_one_document(spark, manuals):
    spec = re.compile(r"([0-9]+(?:\.[0-9]+)?) (V|Nm|kg|baud)")
    of = {c: (doc, set(spec.findall(text))) for c, (doc, _, text) in manuals.items()}
    by_doc = {}
    for c, (doc, _) in of.items():
        by_doc.setdefault(doc, []).append(c)
    expected = sorted((a, b, u, x, y) for cs in by_doc.values() for a in cs for b in cs if a < b for x, u in of[a][1] for y, w in of[b][1] if u == w and x != y)
    assert sorted((r["a"], r["b"], r["unit"], r["value_a"], r["value_b"]) for r in run(spark, "competing_values")) == expected and expected


def test_identity_relations_count_every_pair(spark, manuals, questions):
    expected = Counter()
    for a, (_, model, _) in questions.items():
        for _, own, _ in manuals.values():
            relation = "UNKNOWN" if not model or not own else "EXACT_MODEL" if model == own else "SAME_SERIES" if model[:2] == own[:2] else "MISMATCH"
            expected[a, relation] += 1
    assert {(r["ask"], r["relation"]): r["chunks"] for r in run(spark, "identity_relation_matrix")} == dict(expected)


def test_identifier_scope(spark, manuals, questions):
    expected = {
        (a, c) for a, (q, _, _) in questions.items() for c, (_, model, text) in manuals.items()
        if NAME.findall(q) and set(NAME.findall(q)) <= {*NAME.findall(text), model}
    }
    assert {(r["ask"], r["chunk_id"]) for r in run(spark, "identifier_scope")} == expected

