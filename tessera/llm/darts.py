"""DartMinHash: signatures of weighted sets from hashed darts.

Every element owns darts on the plane of weight and rank, thrown by its hash alone at
density one. A dart hits a set if it lies below the element's weight there. Each hit
falls into one of the signature's coordinates by its hash, and a coordinate keeps its
earliest hit, the one of least rank. Two sets agree at a coordinate with a probability
equal to their weighted Jaccard similarity (sum of minima over sum of maxima; with all
weights one, the Jaccard similarity). Darts are thrown in cells whose ranks double, and
a set goes on to later cells only until all coordinates are hit, so about t ln t darts
are looked at however many elements the set has.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from tessera.llm.wordhash import mix

_U = np.uint64
#: The first cell's ranks end here.
FIRST = 2.0**-6
_CELL, _DART, _LEFT, _UP = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


@lru_cache(maxsize=256)
def _poisson(area: float) -> np.ndarray:
    """P(X <= k) for k = 0, 1, ... until nothing is left."""
    k = np.arange(int(area + 12 * area**0.5 + 24))
    logs = -area + k * np.log(area) - np.concatenate([[0.0], np.cumsum(np.log(np.maximum(1, k[1:])))])
    return np.cumsum(np.exp(logs))


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, t: int, weights: np.ndarray | None = None) -> np.ndarray:
    """A row of ``t`` darts (64-bit ids) for each of ``sets`` sets; a set without weight gets zeros.

    ``elements`` are hashes, each once in its set, and ``owner`` says whose they are.
    """
    ranks, ids = np.full(sets * t, np.inf), np.zeros(sets * t, dtype=np.uint64)
    weights = np.ones(len(elements)) if weights is None else weights.astype(np.float64)
    heavy = weights > 0
    elements, owner, weights = elements[heavy], owner[heavy], weights[heavy]
    open_ = np.zeros(sets, dtype=bool)
    open_[owner] = True
    low, high, level = 0.0, FIRST, 0
    while open_.any():
        live = open_[owner]
        if not live.all():
            elements, owner, weights = elements[live], owner[live], weights[live]
        # Cells of weight: [0, 1), [1, 2), [2, 4), ...
        left, right, band = 0.0, 1.0, 0
        some = slice(None)
        while True:
            e, o, w = elements[some], owner[some], weights[some]
            cell = mix(e + _U((_CELL * (level * 64 + band + 1)) & (2**64 - 1)))
            share = _poisson((right - left) * (high - low))
            u = _unit(cell)
            hit = np.flatnonzero(u >= share[0])
            n = np.searchsorted(share, u[hit], side="right")
            which = np.repeat(hit, n)
            number = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(cell[which] + (number + 1).astype(np.uint64) * _U(_DART))
            rank = low + _unit(mix(dart ^ _U(_UP))) * (high - low)
            if band or (w < 1).any():
                inside = left + _unit(mix(dart ^ _U(_LEFT))) * (right - left) < w[which]
                which, dart, rank = which[inside], dart[inside], rank[inside]
            at = o[which] * t + (mix(dart ^ _U(_CELL)) % _U(t)).astype(np.int64)
            np.minimum.at(ranks, at, rank)
            earliest = rank == ranks[at]
            ids[at[earliest]] = dart[earliest]
            left, right, band = right, right * 2, band + 1
            some = np.flatnonzero(weights > left)
            if not len(some):
                break
        open_ &= np.isinf(ranks).reshape(sets, t).any(axis=1)
        low, high, level = high, high * 2, level + 1
    return ids.reshape(sets, t)
