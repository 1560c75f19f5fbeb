"""A minimal perfect hash of a set of 64-bit keys, built and asked in numpy for a whole array at once.

Keys that have a place of a level's bit array to themselves set its bit and are done; the
others go on to the next, smaller level (Limasset et al., 2017). A key's number is the rank of its
bit over all levels, so the numbers of n keys are 0 to n - 1, at about four bits a key.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.wordhash import mix

_U = np.uint64
#: Places for each key of a level.
GAMMA = 2
#: Set bits of each byte.
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place below ``size`` (< 2**32) for each key, another one on each level."""
    return (((mix(keys + _U((level * 0x9E3779B97F4A7C15) % (1 << 64))) >> _U(32)) * _U(size)) >> _U(32)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels in bytes, and the levels' bits one after another. ``keys`` are distinct."""
    sizes, levels, left = [], [], keys.astype(np.uint64)
    while len(left):
        width = -(-GAMMA * len(left) // 8)
        place = _place(left, len(sizes), 8 * width)
        alone = np.bincount(place, minlength=8 * width) == 1
        levels.append(np.packbits(alone))
        sizes.append(width)
        left = left[~alone[place]]
    return np.array(sizes, dtype=np.int64), np.concatenate(levels) if levels else np.zeros(0, dtype=np.uint8)


def number(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The number of each key; another key than those built from gets some number or -1."""
    before = np.concatenate([[0], np.cumsum(_ONES[bits], dtype=np.int64)])
    out = np.full(len(keys), -1, dtype=np.int64)
    open_, start = np.arange(len(keys)), 0
    for level, width in enumerate(sizes.tolist()):
        if not len(open_):
            break
        place = _place(keys[open_], level, 8 * width)
        byte, bit = start + (place >> 3), (place & 7).astype(np.uint8)
        held = bits[byte]
        hit = (held >> (7 - bit)) & 1 == 1
        earlier = _ONES[held & ~(0xFF >> bit).astype(np.uint8)]
        out[open_[hit]] = before[byte[hit]] + earlier[hit]
        open_, start = open_[~hit], start + width
    return out
