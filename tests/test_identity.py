"""Relations, scopes and named products against plain loops over all pairs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import identity as idn

SCHEMA = "chunk_id long, manufacturer string, family string, series string, model string, aliases array<string>, identifiers array<string>"


def norm(x):
    x = re.sub(r"\s*-\s*", "-", re.sub("[‐‑‒–—―−]", "-", x or ""))
    return re.sub(" +", " ", re.sub(r"\s+", " ", x).strip(" ,;:").replace("-", " ")).lower()


def relation(q, c):
    (qm, qf, qs, qo, qa), (cm, cf, cs, co, ca) = ([norm(v) for v in x[:4]] + [{norm(a) for a in x[4] or []} - {""}] for x in (q, c))
    if not (qf or qs or qo) or not (cf or cs or co):
        return "UNKNOWN"
    if qm and cm and qm != cm:
        return "MISMATCH"
    if qo and qo in ca:
        return "EXACT_MODEL"
    if qs and co and co in qa or qs and qs == cs:
        return "SAME_SERIES"
    return "SAME_FAMILY" if qf and qf == cf else "MISMATCH"


def product(r):
    f = r.choice(["ACS", "kinetix", "", "Power Flex", None])
    s = r.choice(["", f and f"{f} {r.choice([500, 600])}"])
    m = r.choice(["", f and f"{f}-{r.choice([510, 520, 600])}", "X–1"])
    a = r.choice([None, [], [x for x in (m, s, f"{s} series") if x], ["kinetix 5 ", m or "", None]])
    return (r.choice(["ABB", "abb ", "Rockwell", "", None]), f, s, m, a)


IDS = [[], ["F0001"], ["f0001", "0x1A"], None, ["F9"]]


@pytest.fixture(scope="module")
def chunks():
    r = random.Random(1)
    return [(i, *product(r), r.choice(IDS)) for i in range(160)] + [(1000 + i, "ABB", "ACS", "ACS 500", "ACS-510", ["ACS-510"], []) for i in range(60)]


def test_relations(spark, chunks):
    r = random.Random(2)
    pairs = [(product(r), product(r)) for _ in range(400)]
    df = spark.createDataFrame([(*a, *b) for a, b in pairs], ", ".join(f"{p}{n} {t}" for p in "qc" for n, t in zip(idn.FIELDS, ["string"] * 4 + ["array<string>"])))
    side = lambda p: F.struct(*[idn.normal(F.col(p + n)).alias(n) for n in idn.FIELDS[:-1]], idn._normal_all(F.col(p + "aliases")).alias("aliases"))
    got = [x[0] for x in df.select(idn.relation(side("q"), side("c"))).collect()]
    assert got == [relation(a, b) for a, b in pairs] and len(set(got)) == 5


def scope(question, products, chunks, k):
    _, confidence, resolved, wanted = question
    rel = {c[0]: {relation(p, c[1:6]) for p in products} for c in chunks}
    tiers = {n: [c[0] for c in chunks if rel[c[0]] & set(idn.RELATIONS[: n + 1])] for n in range(3)}
    every = [c[0] for c in chunks]
    exact, series, family = (tiers[n] for n in range(3))
    rest = [c for c in family if c not in exact]
    if (resolved or 0) > 1:
        name, base = "MULTI_IDENTITY_SCOPE", [("MULTI_IDENTITY_SCOPE", exact), ("FAMILY_SCOPE", rest)]
    elif confidence == "EXACT_MODEL":
        name, base = ("EXACT_MODEL_SCOPE", [("EXACT_MODEL_SCOPE", exact), ("FAMILY_SCOPE", rest)]) if exact else ("UNKNOWN_SCOPE", [("GLOBAL_SCOPE", every)])
    elif confidence == "SERIES":
        name, base = "SERIES_SCOPE", [("SERIES_SCOPE", series or family)]
    elif confidence == "FAMILY":
        name, base = "FAMILY_SCOPE", [("FAMILY_SCOPE", family)]
    else:
        name, base = "GLOBAL_SCOPE", [("GLOBAL_SCOPE", every)]
    want = {w.lower() for w in wanted or []}
    ids = [c[0] for c in chunks if want and want <= {x.lower() for x in c[6] or []}]
    if not any(t for _, t in base):
        base = [("GLOBAL_SCOPE", every)]
    if ids:
        inside = [c for c in ids if any(c in t for _, t in base)] or ids
        base = [("IDENTIFIER_SCOPE", inside)] + [(n, [c for c in t if c not in inside]) for n, t in base]
    picked = [(c, n) for n, t in base for c in sorted(t)][:k]
    return (name, len(exact), len(series), len(family), len(every), len(ids)), [c for c, _ in picked], [n for _, n in picked]


@pytest.mark.parametrize("k", [1, 4, 30])
def test_scopes(spark, chunks, k):
    r = random.Random(3)
    questions = [(i, r.choice(["EXACT_MODEL", "SERIES", "FAMILY", "UNKNOWN", None]), r.choice([0, 1, 2, None]), r.choice(IDS)) for i in range(60)]
    products = {q[0]: [product(r) for _ in range(r.choice([0, 1, 2]))] for q in questions}
    asked = spark.createDataFrame([(q, *p) for q, ps in products.items() for p in ps], "query_id long, manufacturer string, family string, series string, model string, aliases array<string>")
    df = spark.createDataFrame(chunks, SCHEMA).repartition(4)
    decided, filled = idn.scopes(spark.createDataFrame(questions, "query_id long, confidence string, resolved int, identifiers array<string>"), asked, df, k)
    got = {r["query_id"]: tuple(r)[1:] for r in decided.collect()}
    rows = sorted(filled.collect(), key=lambda x: (x["query_id"], x["rank"]))
    levels = set()
    for q in questions:
        want, ids, names = scope(q, products[q[0]], chunks, k)
        own = [x for x in rows if x["query_id"] == q[0]]
        assert got[q[0]] == want
        assert ([x["chunk_id"] for x in own], [x["level"] for x in own], [x["rank"] for x in own]) == (ids, names, list(range(1, len(ids) + 1)))
        levels |= set(names)
    assert k < 30 or len(levels) >= 5


def named(text, c):
    said = norm(text)
    words = {w for w in re.findall("[a-z0-9]+", said) if len(w) >= 3 and w not in idn.GENERIC}
    numbers = set(re.findall(r"\d+", said))
    for term in filter(None, (c[3], c[2], c[1], *(c[4] or []))):
        for v in {norm(term), re.sub(r"(?:-|\s*)series$", "", norm(term))}:
            if len(v) >= 3 and (re.search(r"\d", v) or re.match("[a-z][a-z0-9]*[A-Z]", term)):
                if re.search(rf"(?<![a-z0-9]){re.escape(v)}(?![a-z0-9])", said):
                    return True
                own = set(re.findall(r"\d+", v))
                if any(v.startswith(w) and len(w) >= max(3, len(v) // 2) and (not own or numbers <= own) for w in words):
                    return True
    return False


def test_named_products(spark):
    r = random.Random(5)
    parts = ["ArmorBlock 5000", "ctrlX CORE", "ctrlX", "ACS-510", "ACS510", "PowerFlex 525", "X-1 (b)", "kinetix 5700 series", "Flex", "m2"]
    products = [(r.choice(["ABB", None]), *(r.choice(["", None, *parts]) for _ in range(3)), r.choice([None, [], [r.choice(parts), r.choice(parts)]])) for _ in range(50)]
    texts = [" ".join(r.choice([*parts, "armorblock", "armorblo", "arm", "5000", "kinetix", "power", "powerflex 52", "the drive", "acs", "510", "ctrlx core x", "(b)", "x-1 (b)", "acs5"]) for _ in range(r.randint(0, 4))) for _ in range(80)]
    df = spark.createDataFrame([(i, *p, []) for i, p in enumerate(products)], SCHEMA)
    got = {}
    for x in idn.mentioned(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"), df).collect():
        got.setdefault(x["query_id"], set()).add(tuple(x)[1:])
    want = {i: {tuple(norm(v) for v in p[:4]) for p in products if named(t, p)} for i, t in enumerate(texts)}
    assert got == {i: w for i, w in want.items() if w} and len(got) > 30
