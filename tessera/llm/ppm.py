"""Prediction by partial matching over bytes, as arrays: windows, the trie's levels, and escapes.

Symbols are the bytes of a text's lower-cased words joined by one space, and a line feed
as its end. A context is up to ORDER bytes before a symbol (line feeds before the start).
A symbol is predicted from the longest context that has been seen. If that context has
no such symbol, the model escapes to the next shorter one, where all symbols of the
longer context are excluded: they would have been coded there. Escapes follow method D:
of each symbol's occurrences in a context a half goes to the escape, again without what is
excluded. Under the empty context, symbols that have never been seen share evenly.

Every context and symbol that occurs is a node; none is left out. The symbols of a context
are a subset of those of its suffix, so what is excluded from a context depends on the one
longer context alone. A window (a symbol with ORDER bytes of context) that has been seen
needs its own node and context; one that has not carries the symbols of the longer context
and what its escapes have cost from level to level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ORDER = 6
HALF = 0.5
END = b"\n"
#: Symbols that are looked at together; a longer text is scored in so many at a time.
PIECE = 1 << 20

_U = np.uint64


def normal(text: bytes) -> bytes:
    """Words lower-cased (A-Z alone), one space between, and the end."""
    return b" ".join(text.lower().split()) + END


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of normal ``texts``, about PIECE at a time, with the texts they are of and where each one's begin.

    A text is cut at multiples of PIECE of its own symbols; contexts reach over the cuts.
    """
    units, size = [], 0
    for i, text in enumerate(texts):
        for s in range(0, len(text), PIECE):
            units.append((i, (END * ORDER + text[:s])[-ORDER:] if s < ORDER else text[s - ORDER : s], text[s : s + PIECE]))
            size += len(units[-1][2])
            if size >= PIECE:
                yield _windows(units)
                units, size = [], 0
    if units:
        yield _windows(units)


def _windows(units: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stream = np.frombuffer(b"".join(before + body for _, before, body in units), dtype=np.uint8)
    lengths = np.array([len(body) for _, _, body in units], dtype=np.int64)
    n = len(stream) - ORDER
    window = stream[ORDER:].astype(np.uint64)
    for k in range(1, ORDER + 1):
        window |= stream[ORDER - k : ORDER - k + n].astype(np.uint64) << _U(8 * k)
    ends = np.cumsum(lengths)
    real = np.ones(n, dtype=bool)
    for k in range(ORDER):
        real[ends[:-1] + ORDER * np.arange(len(units) - 1) + k] = False
    return window[real], np.array([i for i, _, _ in units]), ends - lengths


def counted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the sums of their counts."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[new], np.add.reduceat(counts, new) if len(new) else counts


def mask(order: int) -> np.uint64:
    return _U((1 << (8 * (order + 1))) - 1)


class Level:
    """The nodes of one order (of some contexts, but of those all): sorted windows and counts, by context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts.astype(np.float64)
        self.contexts, self.start = np.unique(keys >> _U(8), return_index=True)
        self.symbols = np.diff(np.append(self.start, len(keys)))
        self.total = np.add.reduceat(self.counts, self.start) if len(keys) else np.zeros(0)

    def seen(self) -> np.ndarray:
        """log10 of each node's probability in its own context."""
        return np.log10(self.counts - HALF) - np.log10(np.repeat(self.total, self.symbols))

    def find(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of contexts, and whether they are there."""
        if not len(self.contexts):
            return np.zeros(len(context), np.int64), np.zeros(len(context), bool)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        return at, self.contexts[at] == context

    def members(self, at: np.ndarray) -> np.ndarray:
        """The symbols of the contexts at ``at``, 256 bits each."""
        places, back = np.unique(at, return_inverse=True)
        n = self.symbols[places]
        row = np.repeat(np.arange(len(places)), n)
        node = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[places], n)
        bits = np.zeros((len(places), 256), np.uint8)
        bits[row, (self.keys[node] & _U(255)).astype(np.int64)] = 1
        return np.packbits(bits, axis=1)[back]


class Asked:
    """Windows that wait for an answer: what their escapes have cost, and the symbols of the longer context (none: not seen yet)."""

    def __init__(self, windows: np.ndarray, cost: np.ndarray | None = None, excluded: np.ndarray | None = None):
        self.windows = windows
        self.cost = np.zeros(len(windows)) if cost is None else cost
        self.excluded = np.zeros((len(windows), 32), np.uint8) if excluded is None else excluded

    def __getitem__(self, some: np.ndarray) -> Asked:
        return Asked(self.windows[some], self.cost[some], self.excluded[some])


def resolve(asked: Asked, order: int, level: Level) -> tuple[np.ndarray, np.ndarray, Asked]:
    """Windows whose symbol is found at ``order`` and their log10 probability, and the others with what the escape costs."""
    window = asked.windows & mask(order)
    at, known = level.find(window >> _U(8))
    below = asked.excluded.any(axis=1)
    total, symbols = np.ones(len(window)), np.zeros(len(window))
    total[known], symbols[known] = level.total[at[known]], level.symbols[at[known]]
    some = np.flatnonzero(below)
    row, symbol = np.nonzero(np.unpackbits(asked.excluded[some], axis=1))
    node = np.searchsorted(level.keys, (window[some[row]] & ~_U(255)) | symbol.astype(np.uint64))
    total[some] -= np.bincount(row, level.counts[node], len(some))
    symbols[some] -= np.bincount(row, minlength=len(some))
    # Where nothing is left of a context, the escape from it is certain.
    norm = np.log10(np.where(total > 0, total, 1.0))
    with np.errstate(divide="ignore"):
        escape = np.where(known & (total > 0), np.log10(HALF * symbols) - norm, 0.0)
    node = np.minimum(np.searchsorted(level.keys, window), max(0, len(level.keys) - 1))
    hit = level.keys[node] == window if len(level.keys) else np.zeros(len(window), bool)
    found = asked.cost[hit] + np.log10(level.counts[node[hit]] - HALF) - norm[hit] if hit.any() else np.zeros(0)
    left = asked[~hit]
    left.cost = left.cost + escape[~hit]
    still = known[~hit]
    if still.any():
        left.excluded[still] = level.members(at[~hit][still])
    return asked.windows[hit], found, left


def unseen(level: Level) -> float:
    """log10 of the probability of a symbol that the empty context does not have."""
    return float(-np.log10(max(1, 256 - len(level.keys))))
