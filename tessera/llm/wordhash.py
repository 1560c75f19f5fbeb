"""Hashes of words and of runs of words for a whole Arrow batch at once, in numpy.

A word's hash is a polynomial of its bytes modulo 2**64, finished by a bijective mixer; a
run's hash is a polynomial of its words' hashes. Both are differences of running sums, so
a batch costs a few passes over its bytes and no Python object for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BYTE, _WORD, _WORD2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}
#: Values (bytes or words) that are hashed at a time.
PIECE = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all (the SplitMix64 finisher)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BYTE))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; no more than 2 * PIECE of them are kept."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 2 * PIECE), base, dtype=np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if len(held) == 2 * PIECE:
            _powers[base] = held
    return held[:n]


def _range(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    back = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _U(0x632BE59BD9B4E019))


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of values[start:end] for each range, the same wherever the range stands.

    Ranges come in order of their starts. Those that start within PIECE values are hashed
    at a time, so what is held besides the result does not grow with the text (but with
    its longest range). ``values`` may be bytes, which stand for _VALUE of themselves.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(starts, np.arange(0, len(values), PIECE)), [len(starts)]]))
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        low, high = int(starts[s]), int(ends[s:e].max())
        part = values[low:high]
        out[s:e] = _range(_VALUE[part] if part.dtype == np.uint8 else part, starts[s:e] - low, ends[s:e] - low, base)
    return out


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count:  # a null row may keep bytes
        column = column.fill_null(b"")
        return raw(column)
    bytes_ = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return bytes_, offsets - offsets[0]


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and for each row the index of its first word (and a last one)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty_like(space)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    return starts, np.flatnonzero(~space & after) + 1, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the batch, and the index of each row's first word (and a last one)."""
    data, offsets = raw(column)
    starts, ends, first = bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), first
    return ranges(data, starts, ends, _BYTE), first


def windows(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows of ``length`` words inside one row, and their hashes."""
    n = np.diff(first)
    room = np.repeat(first[1:] - length, n)
    at = np.flatnonzero(np.arange(len(hashes)) <= room)
    return at, ranges(hashes, at, at + length, _WORD) if len(at) else np.zeros(0, dtype=np.uint64)


def contents(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits for each row's sequence of words, as an array of two columns."""
    padded = hashes if len(hashes) else np.zeros(1, dtype=np.uint64)
    return np.stack([ranges(padded, first[:-1], first[1:], b) for b in (_WORD, _WORD2)], axis=1)
