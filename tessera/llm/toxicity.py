"""Toxicity scores: a weighted lexicon matched by Aho-Corasick in folded text, with exception phrases.

Text is folded before matching: case, accents and compatibility forms, letters of other
scripts that look Latin, and digits and signs that stand for letters. The lexicon (whole
words and beginnings of words) is learned from labelled documents as log odds. Exception
phrases take a match back: longer words that a beginning would also match, and pairs of
a matching word with its neighbour, where clean documents use them. What has matched is
weighed against the number of words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import sliced
from tessera.llm.labelled import held_out, logistic, sample, sigmoid, with_texts
from tessera.llm.shared import documents, settle, table

#: Letters of the Cyrillic and Greek scripts that look like Latin ones, after lower-casing (fixed values).
HOMOGLYPHS = dict(zip("авеікмнорстухјѕԁһԛԝαβεηικνορτυχγω", "abeikmhopctyxjsdhqwabenikvoptuxyw"))
#: Letters with a stroke or without a dot, which have no decomposition (fixed values).
STROKES = dict(zip("ıøłđħŧƀɨɵʉ", "iolhhtbiou")) | {"đ": "d"}
#: Digits and signs that stand for letters (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Signs that stand for letters inside a word only (fixed values).
INSIDE = {"!": "i", "|": "i", "+": "t"}
#: Lengths of the word beginnings that can be in the lexicon.
SHORTEST, LONGEST = 3, 7
#: An entry occurs in so many toxic documents at least and has such odds; an exception in so many clean ones.
LEAST, ODDS = 4, 8.0


class _Fold(dict):
    """What a character becomes, found when it is first met: a letter or digit, or a space."""

    def __missing__(self, code: int) -> str:
        found = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(code)).lower())
        found = "".join(STROKES.get(x, HOMOGLYPHS.get(x, SUBSTITUTES.get(x, x))) for x in found if not unicodedata.combining(x))
        self[code] = made = "".join(x if x.isalnum() else " " for x in found) or ("" if unicodedata.combining(chr(code)) else " ")
        return made


_FOLD = _Fold()
_SIGN = re.compile(r"(?<=\w)[!|+](?=\w)")


def fold(text: str) -> str:
    """The folded text, one space between words and around them."""
    if any(c in text for c in INSIDE):
        text = _SIGN.sub(lambda m: INSIDE[m[0]], text)
    return f" {' '.join(text.translate(_FOLD).split())} "


def entries(folded: str) -> set[str]:
    """What could be in the lexicon for a text: whole words and their beginnings, each after a space."""
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1):
            found.add(f" {word[:n]}")
    return found


def _half(doc_id: object) -> bool:
    """The half of the sample that the lexicon is learned from; the other one calibrates it."""
    return held_out(f"half{doc_id}") or held_out(f"side{doc_id}") or held_out(f"part{doc_id}")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for whole in batches:
        for batch in sliced(whole):
            for i, text, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label"))):
                if _half(i):
                    found = entries(fold(text or ""))
                    (toxic if label else clean).update(found)
                    (toxic if label else clean)[""] += 1
    names = list(toxic.keys() | clean.keys())
    for s in range(0, len(names), 50_000):
        part = names[s : s + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[n] for n in part], pa.int64()), pa.array([clean[n] for n in part], pa.int64())], names=["entry", "toxic", "clean"])


class Lexicon:
    """Entries with weights, exception phrases with the weights they take back, and the calibration."""

    def __init__(self, weights: dict[str, float], exceptions: dict[str, float]):
        self.weights, self.exceptions, self.curve = weights, exceptions, np.array([0.0, 0.0, 0.0, 0.0])

    def automaton(self) -> ahocorasick.Automaton:
        built = ahocorasick.Automaton()
        for entry, weight in [*self.weights.items(), *((e, -w) for e, w in self.exceptions.items())]:
            built.add_word(entry, weight)
        built.make_automaton()
        return built

    def __getstate__(self) -> tuple:
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.exceptions, self.curve = state

    def measure(self, text: str) -> tuple[float, float, float]:
        """The matched weight, by itself and against the number of words."""
        if not self.weights:
            return 0.0, 0.0, 0.0
        if not hasattr(self, "_built"):
            self._built = self.automaton()
        total, folded = 0.0, fold(text)
        for _, weight in self._built.iter(folded):
            total += weight
        total, n = max(total, 0.0), max(1, folded.count(" ") - 1)
        return float(np.log1p(total)), total / n**0.5, float(np.log1p(100 * total / n))

    def score(self, text: str) -> float:
        return float(sigmoid(np.dot(self.curve[:3], self.measure(text)) + self.curve[3]))


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> Lexicon:
    """The lexicon of document counts: entries by how far their odds are from chance, each beginning once."""
    weights: dict[str, float] = {}
    exceptions: dict[str, float] = {}

    def weight(t: int, c: int) -> float:
        return float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))

    ranked = sorted(((weight(t, c) * t, len(e), e, t, c) for e, t, c in counts if t >= LEAST and weight(t, c) >= np.log(ODDS)), key=lambda x: (-x[0], -x[1], x[2]))
    # A beginning that a longer entry accounts for adds nothing, nor does a longer word after its beginning.
    inside: Counter = Counter()
    for _, _, e, t, c in ranked:
        body = e.rstrip(" ")
        if inside[body] < 0.9 * t and not any(body[:n] in weights for n in range(SHORTEST + 1, len(body) + 1)):
            weights[e] = weight(t, c)
            for n in range(SHORTEST + 1, len(body) + 1):
                inside[body[:n]] = max(inside[body[:n]], t)
    for e, t, c in counts:
        if e.endswith(" ") and c >= LEAST and weight(t, c) < 0 and e not in weights:
            own = [weights[e[:n]] for n in range(SHORTEST + 1, len(e)) if e[:n] in weights]
            if own:
                exceptions[e] = sum(own)
    return Lexicon(weights, exceptions)


def phrases(folded: str, lexicon: Lexicon) -> set[str]:
    """Words with their neighbours, for each word that the lexicon matches."""
    words, found = folded.split(), set()
    for k, word in enumerate(words):
        if any(f" {word[:n]}" in lexicon.weights for n in range(SHORTEST, len(word) + 1)) or f" {word} " in lexicon.weights:
            found |= {f" {' '.join(pair)} " for pair in (words[k - 1 : k + 1] if k else [], words[k : k + 2]) if len(pair) == 2}
    return found


def excuse(lexicon: Lexicon, pairs: list[str]) -> None:
    """Makes ``pairs`` exception phrases, which take back what matches in them (once, if one pair's match is another's)."""
    bare = Lexicon(lexicon.weights, dict(lexicon.exceptions)).automaton()
    for pair in pairs:
        taken = sum(w for _, w in bare.iter(pair))
        if taken > 0:
            lexicon.exceptions[pair] = taken


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from a bounded sample: one half gives entries and weights, the other the calibration.

    All counts that are far from chance come to the driver: of at most SAMPLE labelled
    texts, those entries alone that LEAST of them have. Without labels the lexicon is empty.
    """
    chosen = settle(with_texts(docs, sample(labels, "toxic")))
    counts = settle(chosen.mapInArrow(_counted, "entry string, toxic bigint, clean bigint").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")))
    totals = counts.where("entry = ''").first()
    toxic, clean = (totals["t"], totals["c"]) if totals else (0, 0)
    odds = F.log((F.col("t") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(clean + 1.0))
    seen = counts.where("entry <> ''").withColumn("o", odds)
    strong = seen.where((F.col("t") >= LEAST) & (F.col("o") >= float(np.log(ODDS)))).orderBy("entry").collect()
    starts = sorted({r["entry"].rstrip(" ") for r in strong})
    weak = []
    if starts:
        benign = seen.where((F.col("c") >= LEAST) & (F.col("o") < 0) & F.col("entry").endswith(" "))
        near = F.lit(False)
        for n in sorted({len(s) for s in starts}):
            near = near | F.substring("entry", 1, n).isin([s for s in starts if len(s) == n])
        weak = benign.where(near).orderBy("entry").collect()
    lexicon = choose([(r["entry"], r["t"], r["c"]) for r in [*strong, *weak]], toxic, clean)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_in = {True: Counter(), False: Counter()}
        for batch in batches:
            for i, text, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label"))):
                if _half(i):
                    seen_in[bool(label)].update(phrases(fold(text or ""), lexicon))
        names = list(seen_in[True].keys() | seen_in[False].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen_in[x][n] for n in names], pa.int64()) for x in (True, False))], names=["entry", "t", "c"])

    if lexicon.weights:
        pairs = chosen.mapInArrow(paired, "entry string, t bigint, c bigint").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        excuse(lexicon, [r["entry"] for r in pairs.withColumn("o", odds).where((F.col("c") >= LEAST) & (F.col("o") < 0)).orderBy("entry").collect()])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                ids, texts, y = (batch.column(c).to_pylist() for c in ("doc_id", "text", "label"))
                rows = [(*lexicon.measure(t or ""), bool(v)) for i, t, v in zip(ids, texts, y) if not _half(i)]
                if rows:
                    a, b, c, v = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(v)], names=["a", "b", "c", "y"])

    rows = chosen.mapInArrow(measured, "a double, b double, c double, y boolean").orderBy("a", "b", "c", "y").collect()
    x = np.array([r[:3] for r in rows]).reshape(-1, 3)
    lexicon.curve = logistic(x, np.array([float(r["y"]) for r in rows]))
    return lexicon


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; a null text is empty, and an empty one has a score; repeated rows have equal scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                ids = batch.column("doc_id").to_pylist()
                found = [lexicon.score(t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([held_out(i) for i in ids]), pa.array(found), pa.array([int(s >= 0.5) for s in found], pa.int32())],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """A score for every document. Null and empty texts have one; rows that repeat, ids or texts, have equal scores each; null ids are
    not held out; ties in the sample go to the lesser hash and then id; very long texts are whole. Extra columns are not read. No rows for no documents.
    """
    docs = table(spark, folder, "documents")
    return scores(docs, learn(docs, table(spark, folder, "labels")))
