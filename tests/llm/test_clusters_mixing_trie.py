"""Hamerly clustering, pivotal mixing and the prefix trie against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import common
from corvane.llm import hamerly as hm
from corvane.llm import mixing as mx
from corvane.llm import prefix_trie as pt

VECTOR = "vec_id long, embedding array<float>, moved int"


def lloyd(rows, k, rounds, dim=64, scale=256, seed=2):
    kept = [(i, np.floor(scale * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    centroids = [v for _, v in kept[:k]]
    assign = lambda: [min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centroids))[::-1] for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (c, _) in zip(kept, at, strict=True) if c == j]
            if own:
                centroids[j] = np.array([sum(int(v[x]) for v in own) // len(own) for x in range(dim)])
    at = assign()
    per = Counter()
    for c, d in at:
        per[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, per[c], sum(per.values()), digest[c]) for (i, _), (c, d) in zip(kept, at, strict=True))


@pytest.mark.parametrize("seed,rounds", [(1, 5), (2, 8), (3, 0)])
def test_clusters(spark, seed, rounds):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(9, 64)) / 8
    rows = [(i, (centres[i % 9] * (i % 3 > 0) + rnd.normal(size=64) / 20).tolist()) for i in range(260)]
    rows += [(500 + i, rows[7][1]) for i in range(60)]  # many copies of one vector, so ties and empty clusters
    rows += [(600 + i, [0.0] * 64) for i in range(30)] + [rows[3]] * 3 + [(3, rows[4][1])]
    rows += [(700, None), (701, rows[0][1][:63]), (702, [*rows[0][1], 1.0]), (703, [None, *rows[0][1][1:]]), (704, [float("nan"), *rows[0][1][1:]]), (705, [float("inf"), *rows[0][1][1:]]), (706, []), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTOR).repartition(5)
    got = sorted(tuple(r) for r in hm.cluster_vectors(df, k=12, rounds=rounds).collect())
    assert got == lloyd(rows, 12, rounds)


def test_clusters_of_few_or_no_vectors(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(5)]
    got = sorted(tuple(r) for r in hm.cluster_vectors(spark.createDataFrame([(*r, 1) for r in rows], VECTOR)).collect())
    assert got == lloyd(rows, 40, 5) and len(got) == 5
    assert hm.cluster_vectors(spark.createDataFrame([], VECTOR)).collect() == []
    assert hm.cluster_vectors(spark.createDataFrame([(1, [1.0], 1), (2, None, 1)], VECTOR)).collect() == []
    with pytest.raises(Exception, match="too large"):
        hm.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64, 1)], VECTOR)).collect()


def test_bounds_save_scans_and_lose_nothing():
    """Bounds hold after every move, and most vectors of separate groups are not scanned again."""
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-20_000, 20_000, (6, 64))
    x = centres[rnd.integers(0, 6, 400)] + rnd.integers(-900, 900, (400, 64))
    now = x[:6].copy()
    cluster, upper, lower = hm.scan(x, now)
    for _ in range(6):
        before, now = now, np.array([x[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else now[j] for j in range(6)])
        step = hm.Step(before, now)
        cluster, upper, lower = step.update(x, cluster, upper, lower)
        d = hm.squares(x, now)
        assert (cluster == d.argmin(1)).all()
        own = d[np.arange(400), cluster]
        d[np.arange(400), cluster] = np.iinfo(np.int64).max
        assert (upper**2 >= own).all() and (np.maximum(lower, 0) ** 2 <= d.min(1)).all()
    assert (upper < np.maximum(lower, step.half[cluster])).mean() > 0.9


def test_squares_of_large_integers():
    rnd = np.random.default_rng(1)
    x, c = rnd.integers(-(2**26), 2**26, (20, 64)), rnd.integers(-(2**26), 2**26, (7, 64))
    assert hm.squares(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in c] for r in x]


DOC = "doc_id long, text string, source string, target string, n int"


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares in exact fractions, the excess reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return {s: float(share.get(s, most * sizes[s])) for s in names}
        full |= above


def mixed(df, **options):
    return [tuple(r) for r in mx.mix_sources(df, **options).select("doc_id", "size", "source_size", "target", "taken").collect()]


@pytest.mark.parametrize("fan_in,hot", [(4, 20_000), (64, 20)])
def test_mixing(spark, monkeypatch, fan_in, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rnd = random.Random(fan_in)
    rows = []
    for i in range(900):
        source = rnd.choice(["hot"] * 6 + ["b", "B", "ä", "\U0001f600", "￿", "", None, "tiny", "c", "d"])
        n = rnd.choice([0, 1, 3, 20, 60, 400]) if source != "tiny" else 1
        rows.append((i, rnd.choice([" ", "\t\n"]).join(["w x"] * n) if n or i % 2 else None, source, "x", 1))
    rows += [(None, "a b c", "hot", "x", 1)] * 3 + rows[:5] * 4 + [(2000, "", "empty", "x", 1), (2001, None, "empty", "x", 1)]
    size = lambda t: len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    sizes = Counter()
    for _, t, s, _, _ in rows:
        sizes[s] += size(t)
    want, longest, takes = targets(sizes), defaultdict(int), Counter()
    for _, t, s, _, _ in rows:
        longest[s] = max(longest[s], size(t))
    df = spark.createDataFrame(rows, DOC)
    got = mixed(df, fan_in=fan_in)
    assert Counter((r[0], r[1]) for r in got) == Counter((i, size(t)) for i, t, *_ in rows)
    assert sorted(got, key=str) == sorted(mixed(df.repartition(7), fan_in=fan_in), key=str)
    by_target = {}
    for s in sizes:
        by_target.setdefault((sizes[s], round(want[s], 6)), []).append(s)
    for _, n, own, target, taken in got:
        key = (own, round(target, 6))
        assert key in by_target and (taken == 0 if n == 0 else taken % n == 0 and 0 <= taken <= 3 * n)
        assert n == 0 or abs(taken / n - target / own) < 1 + 1e-9
        takes[key] += taken
    for key, names in by_target.items():
        assert abs(takes[key] - len(names) * key[1]) <= sum(longest[s] for s in names) / 2 + 1e-6


def test_mixing_keeps_each_document_at_its_expectation(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * (1 + 7 * (i % 5))), "ab"[i % 3 > 0], "x", 1) for i in range(60)], DOC)
    total, seeds = Counter(), 10
    for seed in range(seeds):
        for i, n, own, target, taken in mixed(df, seed=seed, fan_in=8):
            total[i] += taken / n - target / own
    off = np.array([x / seeds for x in total.values()])
    assert len(off) == 60 and np.abs(off).max() < 0.8 and abs(off.mean()) < 0.05


def test_mixing_of_nothing(spark):
    assert mixed(spark.createDataFrame([], DOC)) == []
    assert mixed(spark.createDataFrame([(1, None, None, "x", 1), (2, " ", "a", "x", 1)], DOC)) in ([(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)], [(2, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0)])


TURN = "conv_id long, turn long, role string, text string, depth int, digest string"


def trie(rows, every=20, heads=4):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % heads for c in own}
    whole = {c: tuple(own.get(c - c % every, [])[: h[c]] + own[c][h[c] :]) for c in own}
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    words = lambda t: len([w for w in "".join(" " if x in " \t\n\v\f\r" else x for x in t).split(" ") if w])
    out = []
    for key, m in members.items():
        below = [k for k in members if k[: len(key)] == key]
        childless = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in members)]
        ends = ",".join(str(c) for c in sorted(m) if whole[c] == key)
        out.append((
            min(m), len(key), min(members[key[:-1]]) if key else None, len(m), sum(len(k) == len(key) + 1 for k in below), len(childless),
            sum((len(members[k]) - 1) * (words(k[-1][1]) if k else 0) for k in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def grown(df, **options):
    return sorted((tuple(r) for r in pt.prefix_trie(df, **options).collect()), key=str)


@pytest.mark.parametrize("seed,hot,piece", [(1, 20_000, 1 << 16), (2, 3, 10)])
def test_trie(spark, monkeypatch, seed, hot, piece):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(pt, "PIECE", piece)
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 90), *range(995, 1010)]:
        if rnd.random() < 0.85:
            for t in range(rnd.choice([1, 2, 3, 4, 6])):
                rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "user", "assistant", None]), rnd.choice(["a b\vc", "a b\vc", "d e", "", None]), 1, "x"))
    rows += [(c, t, "user", "one two", 1, "x") for c in range(200, 260) for t in range(3)]  # many copies of one conversation
    rows += rows[:4] + [(None, 1, "user", "text", 1, "x")]
    rnd.shuffle(rows)
    assert grown(spark.createDataFrame(rows, TURN).repartition(3)) == trie(rows)
    assert grown(spark.createDataFrame(rows, TURN), heads=1) == trie(rows, heads=1)


def test_trie_of_long_or_no_conversations(spark):
    rows = [(c, t, "user", f"turn {t if c < 4 or t < 200 else -t}", 1, "x") for c in (0, 2, 3, 7) for t in range(300 + c)] + [(9, 0, "user", "w " * 200_000, 1, "x")]
    got = grown(spark.createDataFrame(rows, TURN))
    assert {r[1] for r in got} == set(range(308)) and next(r for r in got if r[1] == 0)[3] == 5
    assert grown(spark.createDataFrame(rows[:600] + rows[-1:], TURN)) == trie(rows[:600] + rows[-1:])
    assert grown(spark.createDataFrame([], TURN)) == []
    alone = [(22, 0, None, None, 1, "x")]  # crc32("22") % 4 is not 0, so that no turn is left
    assert grown(spark.createDataFrame(alone, TURN)) == trie(alone)


def test_word_count(spark):
    texts = [None, "", " \t", "a", " a  b\n", "a b c d\x1fe", "\x0b\x0cx\ry", "w " * 50_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(common.word_count(F.col("t"))).collect()]
    assert got == [0, 0, 0, 1, 2, 2, 2, 50_000]
