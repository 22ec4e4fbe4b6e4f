"""Language mixtures against all sets and a grid of shares; packing's least squares and plans against exact ones."""

import itertools
import random

import numpy as np
import pytest

from corvane.llm import language_id as li
from corvane.llm import packing as pk


def by_grid(p, own, steps=40):
    """The best log-likelihood of shares of a few languages, on a grid and then closer around its best point."""
    best, at, width = -np.inf, np.full(len(own), 1 / len(own)), 1.0
    for _ in range(6):
        axes = [np.clip(a + width * np.linspace(-1, 1, steps + 1), 1e-9, 1) for a in at[:-1]] or [np.array([1.0])]
        for head in itertools.product(*axes):
            head = head if len(own) > 1 else ()
            if sum(head) >= 1:
                continue
            share = np.array([*head, 1 - sum(head)])
            value = float(np.log(p[:, own] @ share).sum())
            if value > best:
                best, at = value, share
        width /= 8
    return best, at


@pytest.mark.parametrize("seed", range(12))
def test_language_sets_by_brute_force(seed):
    rnd = np.random.default_rng(seed)
    languages, trigrams = 4, 60
    models = rnd.dirichlet(np.full(trigrams, 0.25), languages).T + 1e-4
    models /= models.sum(0)
    true = rnd.choice(languages, 1 + seed % 2, replace=False)
    share = rnd.dirichlet(np.full(len(true), 8.0))
    text = np.concatenate([rnd.choice(trigrams, max(1, int(s * 900)), p=models[:, k]) for s, k in zip(share, true, strict=True)])
    got, fit = li.infer(text.astype(np.uint64), models)
    p, price = models[text], 2 * np.log(len(text) + 1) + li.GAIN_PER_TRIGRAM * len(text)
    every = {own: by_grid(p, list(own), 40 if len(own) == 2 else 12) for n in (1, 2, 3) for own in itertools.combinations(range(languages), n)}
    want = max(every, key=lambda own: every[own][0] - price * (len(own) - 1))
    assert set(np.flatnonzero(got)) == set(want) == set(true.tolist())
    if len(want) > 1:
        assert got[list(want)] == pytest.approx(every[want][1], abs=0.01)
    assert 0.8 < fit <= 1
    often = np.repeat(text, 30)  # so long that trigrams are counted first
    assert len(often) > 20_000 and set(np.flatnonzero(li.infer(often.astype(np.uint64), models)[0])) == set(want)


def test_mixture_shares_by_grid():
    rnd = np.random.default_rng(3)
    for _ in range(10):
        p = rnd.random((50, 3)) + 0.01
        got, value = li.fit_mixture(p, None, np.full(3, 1 / 3), 5000)
        best, _ = by_grid(p, [0, 1, 2], 24)
        assert value == pytest.approx(best, abs=0.05) and value <= best + 0.05 and got.sum() == pytest.approx(1)
        weight = rnd.integers(1, 5, 50).astype(float)
        whole, same = li.fit_mixture(np.repeat(p, weight.astype(int), axis=0), None, np.full(3, 1 / 3), 5000), li.fit_mixture(p, weight, np.full(3, 1 / 3), 5000)
        assert whole[0] == pytest.approx(same[0], abs=1e-6) and whole[1] == pytest.approx(same[1])


def exact_least_squares(a, b):
    """min |a x - b| with x >= 0: the best of all sets of columns that may be used."""
    best = (float(b @ b), np.zeros(a.shape[1]))
    for n in range(1, a.shape[1] + 1):
        for own in itertools.combinations(range(a.shape[1]), n):
            x = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if (x >= -1e-9).all():
                r = a[:, own] @ x - b
                if r @ r < best[0] - 1e-9:
                    full = np.zeros(a.shape[1])
                    full[list(own)] = x
                    best = (float(r @ r), full)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_least_squares_by_brute_force(seed):
    rnd = random.Random(seed)
    lengths = rnd.sample(range(1, 16), 5)
    patterns = sorted({tuple(sorted(rnd.choices(lengths, k=rnd.randrange(1, 4)))) for _ in range(8)})
    count = np.zeros(17, int)
    for n in lengths:
        count[n] = rnd.randrange(2000)
    a = np.zeros((17, len(patterns)))
    for j, p in enumerate(patterns):
        for n in p:
            a[n, j] += 1
    want, _ = exact_least_squares(a, count.astype(float))
    x = pk.non_negative_least_squares(patterns, count, 20_000)
    r = a @ x - count
    assert (x >= 0).all() and float(r @ r) <= want * 1.001 + 50  # steps under a quarter of a use end the search
    gradient = a.T @ r
    assert (gradient[x == 0] >= -3).all() and np.abs(gradient[x > 0]).max(initial=0) <= 3


def fewest(pieces, capacity):
    """The fewest sequences for a few pieces, by trying all places."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for k in sorted(set(rooms)):
            if k >= pieces[i]:
                left = list(rooms)
                left.remove(k)
                put(i + 1, [*left, k - pieces[i]])
        put(i + 1, [*rooms, capacity - pieces[i]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(30))
def test_plans_against_the_fewest_sequences(seed):
    rnd = random.Random(seed)
    capacity = 20
    pieces = [rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 10))]
    count = np.bincount(pieces, minlength=capacity + 1)
    plan = pk.make_plan(count, capacity)
    used, room = {}, {}
    for length, n, sequence, offset in plan[["length", "n", "sequence", "offset"]].itertuples(index=False):
        for k in range(n):
            used.setdefault(sequence + k, []).append((offset, length))
    assert sorted(x for own in used.values() for _, x in own) == sorted(pieces)
    for own in used.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(used) <= fewest(pieces, capacity) + 1
