"""Sorted runs of sequences that carry their longest common prefixes (LCPs), and a loser-tree merge that uses them.

A sequence is a byte string of steps of STEP bytes each, with an id; the order is that of
(steps, id). A run stores of each sequence only what its predecessor does not have: the
LCP in steps, and the steps after it. In the merge every candidate's LCP with the last
output is known: of two candidates the one with the longer LCP comes first, and only at
equal LCPs are steps compared, from there on (Ng and Kakehi, 2008). So no step that is
shared with the output is looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

STEP = 16


class Run(NamedTuple):
    """A sorted run: of each sequence its id, LCP with the one before, number of steps; the other steps and their weights."""

    ids: bytes
    lcps: bytes
    sizes: bytes
    steps: bytes
    weights: bytes


class Item(NamedTuple):
    """A sequence in the merged stream: ``lcp`` is that with the sequence before; ``weights`` are those of steps[first:]."""

    steps: bytes
    id: int
    lcp: int
    first: int
    weights: np.ndarray


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """The number of steps that ``a`` and ``b`` begin with alike; of the first ``start`` that is known."""
    n = min(len(a), len(b)) // STEP
    low, high = start, n
    while low < high:  # the longest equal stretch by halves: slices are compared as a whole
        middle = (low + high + 1) // 2
        if a[low * STEP : middle * STEP] == b[low * STEP : middle * STEP]:
            low = middle
        else:
            high = middle - 1
    return low


def pack(items: list[tuple[bytes, int, bytes]]) -> Run:
    """A run of sorted (steps, id, weights of four bytes each)."""
    lcps, before = [], b""
    for steps, _, _ in items:
        lcps.append(common(before, steps))
        before = steps
    return Run(
        np.array([i for _, i, _ in items], dtype="<i8").tobytes(),
        np.array(lcps, dtype="<i4").tobytes(),
        np.array([len(s) // STEP for s, _, _ in items], dtype="<i4").tobytes(),
        b"".join(s[n * STEP :] for (s, _, _), n in zip(items, lcps)),
        b"".join(w[n * 4 :] for (_, _, w), n in zip(items, lcps)),
    )


def unpack(run: Run) -> Iterator[Item]:
    """The sequences of a run, in order."""
    weights = np.frombuffer(run.weights, "<i4")
    at, steps = 0, b""
    for id_, lcp, size in zip(*(np.frombuffer(x, k).tolist() for x, k in ((run.ids, "<i8"), (run.lcps, "<i4"), (run.sizes, "<i4")))):
        steps = steps[: lcp * STEP] + run.steps[at * STEP : (at + size - lcp) * STEP]
        yield Item(steps, id_, lcp, lcp, weights[at : at + size - lcp])
        at += size - lcp


def merge(runs: list[Run]) -> Iterator[Item]:
    """The sequences of all runs in order, by a loser tree."""
    k = len(runs)
    readers = [unpack(r) for r in runs]
    heads: list[Item | None] = [next(r, None) for r in readers]
    known = [0] * k  # LCP of each head with the winner that it lost to last, or with the last output

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two leaves whose LCPs with the same earlier sequence are known."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        one, two = heads[a], heads[b]
        n = common(one.steps, two.steps, known[a])
        if (one.steps[n * STEP : (n + 1) * STEP], one.id) > (two.steps[n * STEP : (n + 1) * STEP], two.id):
            a, b = b, a
        known[b] = n
        return a, b

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k else 0
    while k and heads[best] is not None:
        yield heads[best]._replace(lcp=known[best])
        heads[best] = next(readers[best], None)
        known[best] = heads[best].lcp if heads[best] else 0
        node = (best + k) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2
