"""Hashes of words and windows: by hand, the same wherever pieces are cut, and in bounded memory."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality_model, wordhash

from .conftest import prose

M = 1 << 64


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % M
    return x ^ (x >> 31)


def by_hand(values, base):
    return mixed((sum(v * pow(base, i, M) for i, v in enumerate(values)) + len(values) * 0x632BE59BD9B4E019) % M)


@pytest.mark.parametrize("piece", [3, 64, 1 << 18])
def test_hashes_by_hand(monkeypatch, piece):
    monkeypatch.setattr(wordhash, "PIECE", piece)
    monkeypatch.setattr(wordhash, "_powers", {})
    texts = [None, "", prose(1, 40), " a  bb\nccc ", "x" * 100, prose(2, 7), "日本 é", ""]
    hashes, first = wordhash.word_hashes(pa.array(texts))
    words = [w.encode() for t in texts for w in (t or "").split()]
    value = [mixed((b + 1) * wordhash._BYTE % M) for b in range(256)]
    expected = [by_hand([value[b] for b in w], wordhash._BYTE) for w in words]
    assert hashes.tolist() == expected
    assert first.tolist() == np.cumsum([0, *(len((t or "").split()) for t in texts)]).tolist()
    at, found = wordhash.windows(hashes, first, 3)
    assert found.tolist() == [by_hand(expected[i : i + 3], wordhash._WORD) for i in at.tolist()]
    assert wordhash.contents(hashes, first)[:, 0].tolist() == [by_hand(expected[a:b], wordhash._WORD) for a, b in zip(first[:-1], first[1:])]


def test_a_long_text_takes_memory_in_proportion_to_its_words():
    text = pa.array([prose(3, 4000) + " "]).to_pylist()[0] * 1000
    column = pa.array([text], pa.large_string())
    tracemalloc.start()
    hashes, first = wordhash.word_hashes(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hashes) == 4_000_000 and hashes[:4000].tolist() == hashes[-4000:].tolist()
    assert peak < 8 * len(text)


def statistics_by_hand(text):
    words, raw = text.split(), text.encode()
    lines = [tuple(line.split()) for line in text.split("\n") if line.split()]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, size = max(len(words), 1), max(len(raw), 1)
    of = lambda test: sum(map(test, text)) / size
    ascii_of = lambda test: of(lambda c: c < "\x80" and test(c))
    return {
        "log_words": np.log1p(len(words)), "word_bytes": sum(len(w.encode()) for w in words) / n, "long_words": sum(len(w.encode()) > 12 for w in words) / n,
        "short_words": sum(len(w.encode()) < 3 for w in words) / n, "capitals": ascii_of(str.isupper), "digits": ascii_of(str.isdigit),
        "signs": ascii_of(lambda c: c.isprintable() and not c.isalnum() and c != " "), "symbols": of("#*$%&|<>".__contains__), "bars": of("|".__eq__),
        "exclamations": of("!".__eq__), "beyond_ascii": sum(b >= 128 for b in raw) / size, "spaces": ascii_of(str.isspace), "distinct_words": len(set(words)) / n,
        "repeated_next": sum(a == b for a, b in zip(words, words[1:])) / n, "repeated_windows": (len(threes) - len(set(threes))) / max(len(threes), 1),
        "repeated_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "log_lines": np.log1p(len(lines)), "line_words": len(words) / max(len(lines), 1),
    }


def test_statistics_by_hand():
    r = random.Random(4)
    texts = ["", " \n\t\n", "one", "a a a a\na a\n\na a", "日本 é É!", prose(5, 300)]
    texts += ["".join(r.choice(["a", "B", "the ", " ", "\n", "#", "|", "!", "7", "é", "日", "x" * 13, "the end\n"]) for _ in range(r.randint(0, 200))) for _ in range(60)]
    found = quality_model.statistics(pa.array([None, *texts]))
    for text, row in zip(["", *texts], found):
        assert np.allclose(row, [statistics_by_hand(text)[f] for f in quality_model.FEATURES]), text
