"""Winnowed anchors of long sequences, by whole batches in numpy.

A sequence is an array of 64-bit values (bytes through a table, or hashed words). Of
every window of ``window`` values the seed (``seed`` values) with the least hash is its
anchor. Equal windows have equal anchors, so two places can share a window only if they
share an anchor; about 2 / (window - seed + 2) of all positions are anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
SEGMENT = 1 << 19
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverses modulo 2 ** 64, for i < n."""
    have = _powers.get("p", np.empty(0))
    if len(have) < n:
        n = max(n, 1 << 16)
        for name, base in (("p", BASE), ("q", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["q"]


class Rolling:
    """Hashes of any slices of a sequence, from sums of value x power."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        p, self.q = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * p[:n], out=self.sums[1:])

    def raw(self, k: int) -> np.ndarray:
        """Of each slice of k values."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.q[:n]

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.q[lo]


def sliding(x: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """pick over each w neighbours, by doubling."""
    size = 1
    while size * 2 <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, window: int) -> tuple[np.ndarray, ...]:
    """Of the sequences [starts, ends) in values: anchor positions, their sequence, the
    seed's hash, and a hash of all that any window with this anchor can hold."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    n = len(values)
    if n < window:
        return none
    roll, w = Rolling(values), window - seed + 1
    seeds = mix(roll.raw(seed))
    order = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = sliding(order, w)  # by the window's start
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        least[max(s, e - window + 1) : e] = 0  # windows that would leave their sequence
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint32)
    padded[w - 1 : w - 1 + len(least)] = least
    at = np.flatnonzero(sliding(padded, w, np.maximum) == order)
    if not len(at):
        return none
    of = np.searchsorted(starts, at, "right") - 1
    lo, hi = np.maximum(at - (window - seed), starts[of]), np.minimum(at + window, ends[of])
    around = mix(roll.between(lo, hi) ^ ((at - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (hi - lo).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    return at, of, seeds[at], around


def segments(lengths: np.ndarray, seed: int, window: int, limit: int = SEGMENT) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Pieces of bounded size: (first sequence, end sequence, lo, hi, own_lo, own_hi).

    Short sequences go together whole; a longer one is cut, each piece with the context
    that its own anchors need, so that every anchor comes from just one piece."""
    i, n = 0, len(lengths)
    while i < n:
        if lengths[i] > limit:
            for a in range(0, int(lengths[i]), limit):
                b = min(a + limit, int(lengths[i]))
                yield i, i + 1, max(0, a - window + seed), min(b + window, int(lengths[i])), a, b
            i += 1
            continue
        j, total = i, 0
        while j < n and lengths[j] <= limit and total + lengths[j] <= limit:
            total += int(lengths[j])
            j += 1
        yield i, j, 0, -1, 0, -1
        i = j


def batch_anchors(values: np.ndarray, offsets: np.ndarray, seed: int, window: int, convert=lambda x: x) -> Iterator[tuple[np.ndarray, ...]]:
    """Over sequences values[offsets[i]:offsets[i + 1]], each piece through convert(): (sequence, position in it, seed, around)."""
    for i, j, lo, hi, own_lo, own_hi in segments(np.diff(offsets), seed, window):
        if hi < 0:
            base, part = offsets[i], convert(values[offsets[i] : offsets[j]])
            at, of, a, c = anchors(part, offsets[i:j] - base, offsets[i + 1 : j + 1] - base, seed, window)
            yield of + i, at - (offsets[i:j] - base)[of], a, c
        else:
            part = convert(values[offsets[i] + lo : offsets[i] + hi])
            at, of, a, c = anchors(part, np.zeros(1, np.int64), np.full(1, hi - lo, np.int64), seed, window)
            own = (at + lo >= own_lo) & (at + lo < own_hi)
            yield of[own] + i, at[own] + lo, a[own], c[own]
