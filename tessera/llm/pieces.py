"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

A sequence of tokens is what merging would give exactly if every token is what merging
makes of its own characters and every two neighbours stay two tokens when their
characters are merged again. So the text is covered from the left with the longest
token that an Aho-Corasick automaton finds there; a token that cannot stand beside its
neighbour gives way to the next shorter one, and a position from which no token fits is
marked in a field of failed positions and never entered again: the work is linear.

Characters that are no piece become byte tokens; nothing merges over them. No piece of
such a model has its word mark after another character, and where none joins signs to
letters nothing merges over that border either; so texts are encoded in chunks (spaces
and the word or the signs after them), and a worker keeps the chunks it has met in a
table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.batches import per_text
from tessera.llm.shared import documents, table

MARK = "▁"
#: Chunks and pairs that a worker keeps at most; beyond that its tables start anew.
KEPT = 350_000
#: Up to so many characters are merged without a heap.
SHORT = 16


class Pieces:
    """The pieces of a model file and exact encoding and decoding with them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = model.eos_id()
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(len(names)) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i in range(len(names)) if model.is_control(i)}
        self.unknown = {i for i in range(len(names)) if model.is_unknown(i)}
        plain = [i for i in range(len(names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.names = names
        self.score = {names[i]: model.get_score(i) for i in plain}
        self.ids = {names[i]: i for i in plain}
        self.singles = {p for p in self.ids if len(p) == 1}
        # Only what merging reaches can be part of an encoding.
        self.whole = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.whole), None) for p in self.whole}
        self.automaton = ahocorasick.Automaton()
        for p in self.whole:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        # The automaton's states as strings, each with the longest piece that it begins with.
        self.longest = {p[:n]: next((p[:k] for k in range(n, 0, -1) if p[:k] in self.whole), None) for p in self.whole for n in range(1, len(p) + 1)}
        self.reach = max(map(len, self.whole))
        self.numbers = {p: str(i) for p, i in self.ids.items()}
        self.names_out = [" ⁇ " if i in self.unknown else "" if i in self.silent else n.replace(MARK, " ") for i, n in enumerate(names)]
        self.fits: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        odd = "".join(re.escape(chr(b)) for b in range(32) if chr(b) not in self.singles)
        marks = self.marks()
        self.split = self._splitter(odd, marks)
        # Without other signs in a text the ASCII ones are enough to split it, and quicker.
        self.plain_split = self._splitter(odd, {c for c in marks if c.isascii()})
        other = "".join(re.escape(c) for c in sorted(marks) if not c.isascii())
        self.other_signs = re.compile(f"[{other}]") if other else None

    @staticmethod
    def _splitter(odd: str, marks: set[str]) -> re.Pattern:
        signs = "".join(re.escape(c) for c in sorted(marks))
        return re.compile(f" *[^ {odd}{signs}]+| *[{signs}]+| +|[{odd}]+" if signs else f" *[^ {odd}]+| +|[{odd}]+")

    def marks(self) -> set[str]:
        """Signs that no piece has next to anything but such signs and the word mark: nothing merges from them to a word."""
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:]) if MARK not in (a, b)}
        found = {c for p in self.ids for c in p if not c.isalpha() and c != MARK and c in self.singles}
        while mixed := {c for a, b in pairs if (a in found) != (b in found) for c in (a, b) if c in found}:
            found -= mixed
        return found

    def merge(self, text: str) -> list[str]:
        """The pieces that merging makes of ``text``: the best score first, then the leftmost."""
        if len(text) <= SHORT:
            return self.merge_short(text)
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, made = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != made:
                continue
            parts[i], parts[j] = made, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def merge_short(self, text: str) -> list[str]:
        """``merge`` by looking at all pairs again and again: for a few characters that is the quickest."""
        parts, score = list(text), self.score
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def beside(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` stay two tokens when their characters are merged again."""
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) >= KEPT:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(a + b) == [a, b]
        return known

    def cover(self, text: str) -> list[str] | None:
        """The tokens of ``text``; None if it has a character that is no piece."""
        if text in self.whole:
            return [text]
        if not self.singles.issuperset(text):
            return None
        shorter, fits, failed, longest, deepest, reach = self.shorter, self.fits, None, self.longest, self.automaton.longest_prefix, self.reach
        done: list[str] = []
        head = text[:reach]
        at, token, before, size = 0, longest[head[: deepest(head)]], None, len(text)
        while True:
            while token is not None:
                if before is not None:
                    known = fits.get((before, token))
                    if known is None:
                        known = self.beside(before, token)
                    if not known:
                        token = shorter[token]
                        continue
                if failed is not None:
                    end = at + len(token)
                    if failed[end >> 3] >> (end & 7) & 1:
                        token = shorter[token]
                        continue
                break
            if token is not None:
                done.append(token)
                at += len(token)
                if at == size:
                    return done
                head = text[at : at + reach]
                before, token = token, longest[head[: deepest(head)]]
            else:
                if failed is None:  # a bit for each position, once one has failed
                    failed = bytearray((size >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = done.pop()
                at -= len(token)
                before = done[-1] if done else None
                token = shorter[token]

    def chunk(self, text: str) -> list[int]:
        """The ids of a chunk, with the word mark for its spaces."""
        if text and (tokens := self.cover(text)) is not None:
            return [self.ids[p] for p in tokens]
        ids: list[int] = []
        start = 0
        for i, c in enumerate(text):
            if c not in self.singles:
                if start < i:
                    ids += [self.ids[p] for p in self.cover(text[start:i])]
                ids += [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
                start = i + 1
        return ids + [self.ids[p] for p in self.cover(text[start:])] if start < len(text) else ids

    def known(self, chunk: str) -> str:
        """The ids of a chunk joined by spaces. What they decode to is the chunk itself, or else is in ``odd``."""
        if (joined := self.chunks.get(chunk)) is None:
            marked = chunk.replace(" ", MARK)
            if marked and (tokens := self.cover(marked)) is not None:
                numbers = self.numbers
                joined, spelled = " ".join([numbers[p] for p in tokens]), "".join(tokens).replace(MARK, " ")
            else:
                ids = self.chunk(marked)
                joined, spelled = " ".join(map(str, ids)), self.spell(ids)
            if spelled != chunk:
                self.odd[chunk] = spelled
            elif len(chunk) <= 64:
                if len(self.chunks) >= KEPT:
                    self.chunks.clear()
                self.chunks[chunk] = joined
        return joined

    def encode(self, text: str) -> list[int]:
        """The ids of ``text`` with the end id; the empty text is the end id alone."""
        return [int(i) for c in self.parts(text) for i in self.known(c).split()] + [self.end]

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        plain = self.other_signs is None or text.isascii() or not self.other_signs.search(text)
        return (self.plain_split if plain else self.split).findall(" " + text.replace(MARK, " "))

    def spell(self, ids: list[int]) -> str:
        """The text of ids with its first space; byte tokens in a row are one UTF-8 string."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.names_out[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.names_out[i])
        return "".join(out) + (run.decode("utf-8", "replace") if run else "")

    def decode(self, ids: list[int]) -> str:
        spelled = self.spell(ids)
        return spelled[1:] if spelled[:1] == " " else spelled

    def digest(self, text: str) -> tuple[int, str, str]:
        """How many ids, and the SHA-256 of the ids and of the decoded text."""
        known, get, parts = self.known, self.chunks.get, self.parts(text)
        joined = " ".join([get(c) or known(c) for c in parts] + [str(self.end)])
        decoded = "".join([self.odd.get(c, c) for c in parts] if self.odd else parts)
        self.odd.clear()
        decoded = decoded[1:] if decoded[:1] == " " else decoded
        return joined.count(" ") + 1, sha(joined), sha(decoded)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The model of a file, once for each Python worker."""
    return Pieces(path)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document; null texts are empty.

    Repeated rows give repeated results. The file named by ``path`` (default: the
    installed model) must be on every executor.
    """
    path = path or model_path()
    return per_text(documents(docs), lambda text: load(path).digest(text), "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (decimal, joined by spaces) and decoded text of each document."""
    path = path or model_path()

    def row(text: str) -> tuple[str, str]:
        ids = load(path).encode(text)
        return " ".join(map(str, ids)), load(path).decode(ids)

    return per_text(documents(docs), row, "ids string, decoded string")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document. Null and empty texts have the end id alone; rows that repeat have equal rows; of pieces that could stand equally the library's choice stands; very long texts
    are whole. Extra columns are not read. No rows for no documents.
    """
    return digests(table(spark, folder, "documents"))
