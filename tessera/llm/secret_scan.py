"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

A candidate is a maximal run of key characters, after ``=`` as well. Its encoding is inferred (digits, hexadecimal in one case
or in both, letters, base 32, base 36 or base 64; hexadecimal and base 36 also in groups with dashes; ``0x`` in front is no part of it); the run is then tested for what an encoded random key
shows and prose does not:

* uniformity over the encoding's alphabet (chi-squared in eight equal blocks of it);
* the number of runs (above and below the alphabet's middle, Wald-Wolfowitz);
* the serial correlation of neighbouring values.

In this form the tests ask whether a run can be random, and one that any of them refuses at
REFUSED is no key. Whether it can be written text is asked of the same three aspects by
likelihood: the frequencies of letters in two languages (uniformity), the runs of small letters, capitals,
digits and signs (runs), and the alternation of vowels and consonants or the order of keys (serial dependence).
The probability of the run as written text over that of a random key in its encoding is a
p-value under the null hypothesis of text: by Markov's inequality it is below p with
probability p at most, for runs of any length. The p-values of a document's candidates go
through the weighted Benjamini-Hochberg procedure with weights in proportion to length, so
that a long run needs less evidence at each place.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import per_text
from tessera.llm.shared import documents, table, whole

#: Fixed patterns. Case is free in the first one's letters only, and for ASCII letters only.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
KINDS = ("assign", "access", "hex", "random")
#: The rate of false discoveries, and the level at which a test refuses.
RATE, REFUSED = 0.01, 0.001
#: Letters (a to z) in ten thousand of written English and Polish, without marks on letters, and what counts as vowels (fixed values).
LETTERS = (
    (817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7),
    (990, 147, 436, 325, 877, 30, 142, 108, 821, 228, 351, 392, 280, 572, 860, 313, 1, 469, 498, 398, 250, 4, 465, 2, 376, 653),
)
VOWELS = ("aeiou", "aeiouy")
#: Rows of keys, and of signs that people type one after another; the share of steps to a neighbour in such a run.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "01234567890")
TYPED = 0.85
#: Of a letter after a vowel, and after a consonant: the share of vowels.
AFTER_VOWEL, AFTER_CONSONANT = 0.15, 0.52
#: How often a small letter, capital, digit or sign is followed by each of these, in five manners of writing: plain
#: words, words and names in mixed case, capitals, numbers, and paths or names joined by signs.
MANNERS = (
    ((0.990, 0.003, 0.003, 0.004), (0.500, 0.490, 0.005, 0.005), (0.20, 0.05, 0.65, 0.10), (0.80, 0.09, 0.10, 0.01)),
    ((0.86, 0.07, 0.03, 0.04), (0.62, 0.32, 0.03, 0.03), (0.15, 0.15, 0.60, 0.10), (0.60, 0.20, 0.15, 0.05)),
    ((0.400, 0.500, 0.050, 0.050), (0.005, 0.960, 0.015, 0.020), (0.02, 0.20, 0.66, 0.12), (0.02, 0.78, 0.17, 0.03)),
    ((0.30, 0.10, 0.50, 0.10), (0.10, 0.30, 0.50, 0.10), (0.02, 0.02, 0.85, 0.11), (0.05, 0.05, 0.87, 0.03)),
    ((0.80, 0.01, 0.03, 0.16), (0.50, 0.40, 0.05, 0.05), (0.06, 0.02, 0.62, 0.30), (0.76, 0.08, 0.15, 0.01)),
)

_B64 = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")} | {"-": 62, "_": 63}
_B32 = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")}
_HEX = {c: i for i, c in enumerate("0123456789abcdef")} | {c: i for i, c in enumerate("ABCDEF", 10)}
_B32L = {c.lower(): i for c, i in _B32.items()}
_B36 = {c: i for i, c in enumerate("0123456789abcdefghijklmnopqrstuvwxyz")} | {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 10)}
_LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")} | {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
#: The encodings, the narrowest first. The dashes of a grouped run are no values.
ENCODINGS = (
    ("digits", _HEX, 10, re.compile(r"[0-9]+")),
    ("hex", _HEX, 16, re.compile(r"[0-9a-f]+|[0-9A-F]+")),
    ("grouped hex", _HEX, 16, re.compile(r"[0-9a-f]+(?:-[0-9a-f]+)+|[0-9A-F]+(?:-[0-9A-F]+)+")),
    ("mixed hex", _HEX, 16, re.compile(r"[0-9a-fA-F]+")),
    ("letters", _LETTERS, 26, re.compile(r"[A-Z]+|[a-z]+")),
    ("base32", _B32 | _B32L, 32, re.compile(r"[A-Z2-7]+|[a-z2-7]+")),
    ("base36", _B36, 36, re.compile(r"[A-Z0-9]+|[a-z0-9]+")),
    ("grouped base36", _B36, 36, re.compile(r"[A-Z0-9]+(?:-[A-Z0-9]+)+|[a-z0-9]+(?:-[a-z0-9]+)+")),
    ("base64", _B64, 64, re.compile(r"[A-Za-z0-9+/_-]+")),
)


def tail_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def tail_chi2(x: float, k: int) -> float:
    """The upper tail of chi-squared with ``k`` degrees, by the Wilson-Hilferty normal form."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def bare(run: str) -> str:
    """A run without padding and without the mark of a hexadecimal number."""
    body = run.rstrip("=")
    return body[2:] if body[:2] in ("0x", "0X") else body


def infer(run: str) -> tuple[str, list[int], int]:
    """The narrowest encoding that has all characters, the values, and the alphabet's size."""
    body = bare(run)
    for name, values, size, pattern in ENCODINGS:
        if pattern.fullmatch(body):
            return name, [values[c] for c in body if c in values], size
    return "none", [], 0


def refused(values: list[int], size: int) -> bool:
    """Whether one of the three tests says that the values are not random."""
    n, blocks = len(values), 8
    counts = [0] * blocks
    for v in values:
        counts[v * blocks // size] += 1
    # a block has (size / 8) values of the alphabet, or one more or less where 8 does not divide it
    expected = [n * (-(-(k + 1) * size // blocks) - -(-k * size // blocks)) / size for k in range(blocks)]
    if tail_chi2(sum((c - e) ** 2 / e for c, e in zip(counts, expected)), blocks - 1) < REFUSED:
        return True
    high = [v * 2 >= size for v in values]
    a = sum(high)
    b = n - a
    if not a or not b:
        return True
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    mean = 2 * a * b / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    if spread <= 0 or tail_normal((runs - mean) / math.sqrt(spread)) < REFUSED:
        return True
    middle = sum(values) / n
    off = [v - middle for v in values]
    power = sum(x * x for x in off)
    r = sum(x * y for x, y in zip(off, off[1:])) / power if power else 1.0
    return tail_normal(r * math.sqrt(n)) < REFUSED


def kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def _letters(counts: tuple[int, ...], vowels: str) -> tuple[str, dict, dict]:
    """Vowels, log shares of a letter among its kind, and those of a vowel or consonant after another."""
    share = {chr(97 + i): n / sum(counts) for i, n in enumerate(counts)}
    v = sum(share[c] for c in vowels)
    own = {c: math.log(p / (v if c in vowels else 1 - v)) for c, p in share.items()}
    turn = {(before, w): math.log(p if w else 1 - p) for before, p in ((True, AFTER_VOWEL), (False, AFTER_CONSONANT), (None, v)) for w in (True, False)}
    return vowels, own, turn


_TABLES = [_letters(*x) for x in zip(LETTERS, VOWELS)]
_NEXT = {(x, y) for row in ROWS for a, b in zip(row, row[1:]) for x, y in ((a, b), (b, a))}
_MANNERS = [[[math.log(p) for p in row] for row in manner] for manner in MANNERS]
_SIGNS, _DIGIT = math.log(1 / 4), math.log(1 / 10)


def _mean(logs: list[float]) -> float:
    """The log of the mean of what the logs stand for."""
    top = max(logs)
    return top + math.log(sum(math.exp(v - top) for v in logs) / len(logs))


def _spelled(body: str, kinds: list[int], table: tuple) -> float:
    """The log probability of a run's letters, digits and signs, each given its kind, by a language's letters."""
    vowels, own, turn = table
    total, before = 0.0, None
    for c, k in zip(body, kinds):
        if k < 2:
            total += turn[before, c in vowels] + own[c]
            before = c in vowels
        else:
            total += _DIGIT if k == 2 else _SIGNS
            before = None
    return total


def _typed(body: str) -> float:
    """The log probability of a run as neighbouring keys, or letters or digits in a row."""
    near = sum(step in _NEXT for step in zip(body, body[1:]))
    return math.log(1 / 36) + near * math.log(TYPED / 2) + (len(body) - 1 - near) * math.log((1 - TYPED) / 36)


def written(body: str) -> float:
    """The log probability of a run as written text: the mean over the manners of writing, the languages, and typing along the keys."""
    kinds = [kind(c) for c in body]
    steps = list(zip(kinds, kinds[1:]))
    manners = _mean([math.log(1 / 4) + sum(manner[x][y] for x, y in steps) for manner in _MANNERS])
    low = body.lower()
    return _mean([*(manners + _spelled(low, kinds, t) for t in _TABLES), _typed(low)])


def evidence(run: str) -> float:
    """The probability of the run as written text over that as a random key of its encoding, 1 at most; 1 if a test refuses the run."""
    name, values, size = infer(run)
    if not size or refused(values, size):
        return 1.0
    body = bare(run)
    body = body.replace("-", "") if name.startswith("grouped") else body
    # One case for all letters is one more choice of two; each letter's own case is one for each.
    cases = sum(c.isalpha() for c in body) if name == "mixed hex" else 0 if name in ("digits", "base64") else 1
    random_ = -len(values) * math.log(size) - cases * math.log(2)
    return math.exp(min(0.0, written(body) - random_))


def discoveries(runs: list[str]) -> list[bool]:
    """Weighted Benjamini-Hochberg at RATE over the runs of a document; weights follow length."""
    mean = sum(map(len, runs)) / max(1, len(runs))
    held = sorted((evidence(r) * mean / len(r), i) for i, r in enumerate(runs))
    passed = max((k for k, (p, _) in enumerate(held, 1) if p <= RATE * k / len(runs)), default=0)
    out = [False] * len(runs)
    for _, i in held[:passed]:
        out[i] = True
    return out


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find, each kind leftmost and without overlap."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def added(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that the battery finds and that no base span touches."""
    if not any(len(w) >= 20 for w in text.split()):
        return []
    free, ends, k = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while k < len(known) and known[k][0] < m.end():
            ends = max(ends, known[k][2])
            k += 1
        if ends <= m.start():
            free.append(m)
    return [(m.start(), 3, m.end()) for m, is_key in zip(free, discoveries([m.group() for m in free])) if is_key]


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(text: str) -> tuple:
    known = base(text)
    n = [sum(k == i for _, k, _ in known) for i in range(3)]
    return (*n, hashlib.sha256(spell(known).encode()).hexdigest(), spell(sorted(known + added(text, known))))


def redacted(text: str) -> tuple[str]:
    """The text with every span replaced by its kind; overlapping spans are one."""
    known = base(text)
    out, at = [], 0
    for s, k, e in sorted(known + added(text, known)):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = e
    return ("".join(out) + text[at:],)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scans(docs: DataFrame) -> DataFrame:
    """A row of counts and spans for each document; null and empty texts have none.

    Offsets are code points of the whole text. Repeated rows give repeated results.
    """
    return per_text(documents(docs), scan, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in the text replaced; null texts stay null, all other columns stay as they are, whatever they are called.

    n_chars, where there is such a column, is counted again. Repeated rows give repeated results.
    """
    made = per_text(docs.select(whole(docs), "text"), redacted, "hidden string", keep=("row",))
    fields = {"text": F.when(F.col("row.text").isNotNull(), F.col("hidden"))}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(F.col("row.text").isNull(), F.col("row.n_chars")).otherwise(F.char_length("hidden").cast(docs.schema["n_chars"].dataType))
    return made.select(*(fields.get(c, F.col("row.`" + c.replace("`", "``") + "`")).alias(c) for c in docs.columns))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of every document. Null and empty texts have none; rows that repeat have equal spans; spans that start together come in the order of their kinds; very long texts are whole. Extra columns
    are not read. No rows for no documents.
    """
    return scans(table(spark, folder, "documents"))
