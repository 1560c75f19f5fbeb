from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, words string, kept boolean, part int, `key` string"


def rows(texts, first=1):
    return [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], None if t is None else len(t), 0.5, 1, "x", True, 7, "k") for i, t in enumerate(texts, first)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("the of and".split()) if r.random() < 0.3 else "".join(r.choice(["th", "er", "in", "on", "an", "es"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, repeated rows, ids that repeat, and columns whose names clash."""
    long = prose(1, 30_000)
    texts = [None, "", " \n\t ", "one", "a b c d", prose(2, 80), prose(2, 80), prose(3, 60) + "\n" + prose(3, 60), long, long + " end", "x" * 50_000, "Grüße aus 日本 \x00\x1c 𠮷 ▁x"]
    data = rows(texts)
    data += [data[5], data[5], (None, prose(2, 80), None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), (6, prose(9, 70), "en", "a", 1, 0.1, 2, "y", False, 1, "k")]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(1, 12)] + [(5, None, None), (None, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")


#: Columns whose names an operator may use itself, or that need quoting.
CLASHING_SCHEMA = "doc_id long, text string, cell string, shard string, bits string, ids string, kept string, n string, `a b` string, `a.b` string"


def clashing(n):
    return [(i, prose(i % 7, 40) + "\n" + prose(i, 30), *"abcdefgh") for i in range(n)]
