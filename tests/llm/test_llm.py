"""The corpus operators against brute force, and on nulls, empty tables, ties and clashing columns."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontaminate as dc
from corvane.llm import html_extract as hx
from corvane.llm import language_id as li
from corvane.llm import lattice_lm as lm
from corvane.llm import line_dedup as ld
from corvane.llm import ngram_jaccard as nj
from corvane.llm import packing as pk
from corvane.llm import substring_dedup as sub
from corvane.llm import suffix_dedup as suf
from corvane.llm import voronoi_topk as vt

SCHEMA = "doc_id long, text string, lang string, source string, n_removed long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)


def sample(seed, n=120, words=60, vocabulary=6):
    rnd = random.Random(seed)
    voc = [f"w{i}" for i in range(vocabulary)]
    base = [[rnd.choice(voc) for _ in range(words)] for _ in range(5)]
    rows = []
    for i in range(n):
        b, k = list(rnd.choice(base)), rnd.random()
        if k < 0.3:
            b[rnd.randrange(words)] = f"#{i}"
        elif k < 0.6:
            j = rnd.randrange(words - 10)
            b = [f"x{i}", *b[j : j + rnd.randrange(10, 50)], f"y{i}"]
        elif k > 0.75:
            b = [rnd.choice(voc) for _ in range(rnd.randrange(words))]
        rows.append((i, " \n".join(b)))
    return [*rows, (1000, None), (1001, ""), (None, "no id"), (1002, "é" * 500)]


def test_substring(spark):
    rows = sample(1)
    first, words = {}, {i: (t or "").encode().split() for i, t in rows if i is not None}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][j : j + 13]), i)
    want = {}
    for i, w in words.items():
        gone = {k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    assert {r[0]: tuple(r)[1:4] for r in sub.substring_dedup(table(spark, rows)).collect()} == want


@pytest.mark.parametrize("limit", [100_000, 2])
def test_suffix(spark, limit):
    rows = sample(2, words=120)
    texts = {i: (t or "").encode() for i, t in rows if i is not None}
    count = Counter(b[j : j + 200] for b in texts.values() for j in range(len(b) - 199))
    want = {}
    for i, b in texts.items():
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if count[b[j : j + 200]] > 1:
                gone[j : j + 200] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    assert {r[0]: tuple(r)[1:5] for r in suf.suffix_dedup(table(spark, rows), group_limit=limit).collect()} == want


def test_deep_shallow():
    rnd = random.Random(3)
    rows = np.array([[rnd.choice(b"ab") for _ in range(60)] for _ in range(200)], np.uint8)
    rows[50:120, :50] = rows[0, :50]
    rows[120:130] = rows[1]
    order, lcp = suf.deep_shallow(rows, 16)
    got = [rows[i].tobytes() for i in order]
    assert got == sorted(r.tobytes() for r in rows)
    assert all(lcp[k] == suf.common_prefix(got[k - 1], got[k]) for k in range(1, 200))


def test_lines(spark):
    rnd = random.Random(4)
    lines = [f"line {i}" for i in range(6)] + ["L" * 220, "", "  "]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(9)))) for i in range(60)] + [(100, None), (None, "line 1\nline 2")]
    for k in (1, 2, 3):
        seen, want = set(), {}
        for i, t in rows:
            if i is None or t is None:
                want[i] = t
                continue
            own = t.split("\n")
            at = [j for j, x in enumerate(own) if x.strip()]
            gone = set()
            for j in range(len(at)):
                for n in {k, 1}:
                    key = tuple(own[x] for x in at[j : j + n])
                    if len(key) == n and (n == k or len(key[0]) >= 200):
                        gone |= {*at[j : j + n]} if (n, key) in seen else set()
                        seen.add((n, key))
            want[i] = "\n".join(x for j, x in enumerate(own) if j not in gone)
        got = ld.line_dedup(table(spark, rows), min_lines=k)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_removed"]
        assert {r["doc_id"]: r["text"] for r in got.collect()} == want


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK_ROWS", block)
    rows = [(i, t) for i, t in sample(5, words=90, vocabulary=40) if i is not None]
    known = nj.WordNumbers()
    sets = {i: set(nj.shingles(t or "", 5, known).tolist()) for i, t in rows}
    links, root = Counter(), {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in nj.jaccard_join(table(spark, rows)).collect()}
    assert got == {i: (root[i], links[i]) for i in sets}
    assert sum(links.values()) > 100
    kept = {r["doc_id"] for r in nj.keep_one(table(spark, [*rows, (None, "x")])).collect()}
    assert kept == {i for i in sets if root[i] == i} | {None}


def test_decontamination(spark):
    items = [(1, "What is the large river of this old country? It is the broad blue river there."), (2, "one two three four five six seven eight nine ten eleven twelve"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(300))
    docs = [(1, f"{filler} {items[0][1]} {filler}"), (2, filler), (3, None), (4, ""), (None, items[0][1]), (5, f"{filler} one TWO three, four five six seven eight nine ten eleven twelve"), (6, "What is the large river of this old country? " + filler)]
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(table(spark, docs), bench).collect()}
    assert got == {(1, 1), (5, 2)}
    many = dc.find_leaks(table(spark, docs), bench, items_at_once=1)
    assert {(r["doc_id"], r["item_id"]) for r in many.collect()} == got
    assert {r["doc_id"] for r in dc.decontaminate(table(spark, docs), bench).collect()} == {2, 3, 4, None, 6}
    assert dc.find_leaks(table(spark, docs), bench.limit(0)).count() == 0


def test_wand_finds_all():
    rnd = random.Random(6)
    voc = [f"v{i}" for i in range(80)]
    items = [(i, " ".join(rnd.choice(voc) for _ in range(rnd.randrange(4, 20)))) for i in range(60)]
    index = dc.Index(items, 5, dc.Totals.of(t for _, t in items), 64)
    for _ in range(200):
        words = {index.number[w] for w in rnd.sample(voc, 30) if w in index.number}
        score = Counter()
        for w in words:
            for k, x in zip(*index.postings(w)[:2], strict=True):
                score[k] += x
        want = {k for k, x in score.items() if x >= 0.4}
        assert {k for k, _ in index.retrieve(words, 0.4)} == want
        assert not want or index.bounds(np.array([*words, len(index.number)]), 1)[0] >= 0.4 - 1e-4


def test_minimum_cut():
    rnd = random.Random(7)
    for _ in range(150):
        n = rnd.randrange(1, 8)
        a, b = ([rnd.random() * 2 for _ in range(n)] for _ in range(2))
        edges = [{} for _ in range(n)]
        for i, j in itertools.combinations(range(n), 2):
            if rnd.random() < 0.5:
                edges[i][j] = edges[j][i] = rnd.random() * 2
        cost = lambda s: sum(b[i] if s[i] else a[i] for i in range(n)) + sum(w for i in range(n) for j, w in edges[i].items() if j < i and s[i] != s[j])  # noqa: B023, E731
        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(hx.minimum_cut(a, b, edges)) == pytest.approx(best)
        flow = hx.content_side(list(range(n)), [x - y for x, y in zip(a, b, strict=True)], [dict(e) for e in edges])
        assert cost([i in flow for i in range(n)]) == pytest.approx(best)


def test_html(spark):
    page = "<head><title>t</title></head><body><nav><li><a href=x>Home</a></nav><article><h1>Head &amp; tail</h1><p><b>One\n two.<br><p>Three&nbsp;four five.</p><div class='ad'>Buy this now, it is good.</div></article><section id=comments><p>Great text, I liked it very much.</p></section><footer>&copy; us</footer>"
    assert hx.extract(page) == "Head & tail\nOne two.\nThree four five."
    got = hx.extract_pages(spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (None, "v", "", 1)], "page_id long, url string, html string, text int"))
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in got.orderBy(F.desc("n_chars"), F.desc("page_id")).collect()] == [(1, "u", 37), (2, None, 0), (None, "v", 0)]


def test_language(spark):
    rnd = random.Random(8)
    make = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(80))
    rows = [(i, make("abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz") for i in range(80)] + [(100, None, "aa"), (101, "123 !", None), (102, f"{make('abcde')} {make('vwxyz')}", None), (None, "abc", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in li.identify(docs, "doc_id % 4 <> 2").collect()}
    assert all(got[i]["lang_pred"] == ("aa" if i % 2 else "zz") and 0.9 < got[i]["score"] <= 1 for i in range(80))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[101]["score"] == 0
    assert len(got[102]["languages"]) == 2 and None not in got
    assert {r["lang_pred"] for r in li.identify(docs, "false").collect()} == {"und"}
    assert li.identify(docs.limit(0)).count() == 0


def test_lattice(spark):
    pieces, weight = lm.load_pieces(lm.default_vocabulary())
    lattice, at = lm.Lattice(pieces), {p: i for i, p in enumerate(pieces)}
    for word in (b" the", b" \xc3\xa9tre,", b" zzqx!!"):
        sums = [1.0] + [0.0] * len(word)
        for i, j in itertools.combinations(range(len(word) + 1), 2):
            if word[i:j] in at:
                sums[j] += sums[i] * weight[at[word[i:j]]]
        assert lattice.score(np.frombuffer(word, np.uint8)[None, :], np.log(weight))[0] == pytest.approx(np.log(sums[-1]))
    word = np.frombuffer((" " + "straße+ing" * 80).encode(), np.uint8)[None, :]  # over LONG_WORD: another way to the same sums
    edges = lattice.edges(word)
    assert lattice.score(word, np.log(weight))[0] == pytest.approx(lattice.forward(word, np.log(weight), edges)[-1, 0])
    few = word[:, :200]
    assert lattice.long_expected(few[0], 3.0, np.log(weight)) == pytest.approx(lattice.expected(few, np.array([3.0]), np.log(weight)))
    assert np.isfinite(lattice.score(np.full((1, 300_000), 97, np.uint8), np.log(weight))[0])
    rows = [(i, f"the cat sat on Mat {i % 7}") for i in range(40)] + [(100, None), (101, "unseen wörd"), (None, "x")]
    train = [(i, t) for i, t in rows if i is not None and i % 10]
    count = Counter(w for _, t in train for w in [*(t or "").lower().split(), ""])
    n, v = sum(count.values()), len(count)
    for frequent in (300_000, 2):
        got = {r["doc_id"]: r for r in lm.score_texts(table(spark, rows), "doc_id % 10 <> 0", frequent=frequent).collect()}
        assert set(got) == {i for i, _ in rows if i is not None}
        for i, t in rows:
            if i is not None:
                own = [*(t or "").lower().split(), ""]
                assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), n)
                assert got[i]["base_score"] == pytest.approx(sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
                assert got[i]["score"] < 0


def test_packing(spark):
    rows = sample(9) + [(2000, "word " * 9000), (2001, "It's <|endoftext|> ΣΑΣ ½́ 12"), (2002, f"{'abcde' * 20_000} {'abcde' * 20_000}!")]
    got = pk.pack(table(spark, rows), capacity=256, with_ids=True).toPandas()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(pk.default_vocabulary())
    by_doc = dict(list(got.sort_values("piece").groupby("doc_id")))
    for i, t in rows:
        if i is not None:
            want = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            mine = by_doc[i]
            assert np.concatenate([np.frombuffer(x, "<u4") for x in mine["ids"]]).tolist() == want.tolist()
            assert mine["start"].tolist() == list(range(0, len(want), 256)) and mine["length"].iloc[:-1].eq(256).all()
            assert all(zlib.crc32(x) == c for x, c in zip(mine["ids"], mine["ids_crc32"], strict=True))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 256
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 256) + 2
    assert pk.pack(table(spark, rows).limit(0)).count() == 0


def test_voronoi(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    vectors += [(i, vectors[3][1]) for i in range(300, 400)] + [(500, None), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] * 6), (None, vectors[0][1]), (650, [float("inf")] * 6)]
    q = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for i in q:
        if i % 50 == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for block, query_block in ((4096, 8192), (16, 8192), (4096, 2), (16, 2)):
        assert {tuple(r) for r in vt.topk_join(df, block=block, query_block=query_block, pivots=8).collect()} == want
    assert vt.topk_join(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(10)
    make = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(4)) for _ in range(n))
    rows = [(i, make("abcdef" if i % 2 else "uvwxyz", 100), "aa" if i % 2 else "zz", "s", 500) for i in range(40)]
    item = make("abcdef", 30)
    near = rows[1][1].split()
    near[50] = "abab"
    rows += [(50, rows[0][1], "zz", "s", 1), (51, " ".join(near), "aa", "s", 1), (52, f"{make('abcdef', 50)}\n{item}", "aa", "s", 1), (53, None, None, None, None), (54, "12", "aa", "s", 2), (55, f"{rows[2][1]}\n{rows[4][1]}", "zz", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cp.run(spark, str(tmp_path)).toPandas()
    assert set(got["doc_id"]) == set(range(40))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (sub.substring_dedup, suf.suffix_dedup, ld.line_dedup, nj.jaccard_join, lm.score_texts):
        assert f(none).count() == 0
    twice = table(spark, [(1, "a b\nc d"), (1, "a b\nc d")])
    for f in (sub.substring_dedup, suf.suffix_dedup, ld.line_dedup):
        assert f(twice).count() == 2
    assert nj.jaccard_join(twice).count() == 1
