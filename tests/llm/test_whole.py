"""Cases in which the operators once did less than the whole job."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from corvane.llm import common
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

ROW = "doc_id long, text string, lang string, source string, n_chars long"


def test_single_lines(spark):
    line = "This work is licensed under a license of some length."
    rows = [(i, f"own first {i}\n{line}\nown last {i}", "en", "s", 1) for i in range(4)] + [(9, line, "en", "s", 1), (None, line, "en", "s", 1)]
    got = cp.lines_deduplicated(spark, spark.createDataFrame(rows, ROW), "").collect()
    want = {0: rows[0][1], None: line} | {i: f"own first {i}\nown last {i}" for i in range(1, 4)}
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_three_languages_in_even_parts(spark):
    rnd = random.Random(1)
    make = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(n))
    own = {"aa": "abcde", "mm": "klmno", "zz": "vwxyz"}
    rows = [(100 * k + i, make(letters, 80), lang, "s", 1) for k, (lang, letters) in enumerate(own.items()) for i in range(30)]
    rows += [(1000, " ".join(make(letters, 80) for letters in own.values()), None, "s", 1), (1001, "12 !", None, "s", 1), (1002, None, None, "s", 1)]
    got = cp.identified(spark, spark.createDataFrame(rows, ROW), "")
    assert {r["doc_id"] for r in got.collect()} == {r[0] for r in rows} - {1001, 1002} and got.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("held", [16_000_000, 700])
def test_scores_do_not_depend_on_passes(spark, monkeypatch, held):
    monkeypatch.setattr(dc, "ITEM_BYTES", held)
    rnd = random.Random(2)
    voc = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(voc[: 5 + i]) for _ in range(rnd.randrange(10, 40)))) for i in range(30)]
    docs = [(i, " ".join([*t.split()[: len(t.split()) * 4 // 5], *rnd.choices(voc, k=30)])) for i, t in items]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = ({tuple(r)[:2]: tuple(r)[2:] for r in dc.find_leaks(docs, bench, overlap=0.0, items_at_once=n).collect()} for n in (1000, 7))
    each = {tuple(r)[:2] for r in dc.find_leaks(docs.limit(6), bench, overlap=0.0, items_at_once=1).collect()}
    assert each == {k for k in one if k[0] < 6}
    assert len(one) >= 20 and set(one) == set(many)
    assert all(many[k] == pytest.approx(one[k]) for k in one)


def test_language_of_rows_without_an_id(spark):
    rows = [(i, "abc bca cab " * 9, "aa", "s", 1) for i in range(9)] + [(None, "abc cab bca " * 9, None, "s", 1), (None, "12", None, "s", 1)]
    got = cp.identified(spark, spark.createDataFrame(rows, ROW), "").collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in got) == sorted((r[0] is None, r[1]) for r in rows[:-1])


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=(6, 6, 6, 3, 3, 0)[i % 6]).tolist()) for i in range(200)]
    q = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors}
    want = set()
    for i in range(0, 200, 25):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
        want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in vt.topk_join(df, query_filter="vec_id % 25 = 0", pivots=8).collect()} == want


def repeated_ids(seed, n=90, words=60, sep=" "):
    """Rows of which many share an id, with equal and with different texts."""
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(9)}" for _ in range(words)] for _ in range(4)]
    rows = []
    for _ in range(n):
        a, b = rnd.choice(base), rnd.choice(base)
        j, k = rnd.randrange(words), rnd.randrange(words)
        rows.append((rnd.randrange(40), sep.join(rnd.choice([a, a[:j] + b[j:], [f"x{len(rows)}", *a[min(j, k) : max(j, k)]], [f"y{len(rows)}-{i}" for i in range(words)]]))))
    return rows + rows[:10]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_substring_of_repeated_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = repeated_ids(1)
    first = {}
    for i, t in sorted(rows):
        w = t.split()
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    want = Counter()
    for i, t in rows:
        w = t.split()
        gone = {k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    got = sub.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r)[:4] for r in got.collect()) == want
    assert sum(n for (_, _, gone, _), n in want.items() if gone) > 20


def cut_by_brute_force(rows):
    count = Counter(b[j : j + 200] for _, t in rows for b in [t.encode()] for j in range(len(b) - 199))
    want = Counter()
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if count[b[j : j + 200]] > 1:
                gone[j : j + 200] = True
        want[i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    return want


@pytest.mark.parametrize("limit", [100_000, 1])
def test_suffix_of_repeated_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "HOT_ROWS", 20_000 if limit > 1 else 3)
    rows = repeated_ids(2, words=110)
    want = cut_by_brute_force(rows)
    got = suf.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), group_limit=limit)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert any(0 < x[2] < x[1] for x in want)


def test_deeper_buckets(spark):
    """Passages of just under and over the length, in other surroundings each: large buckets down to whole windows."""
    rnd = random.Random(3)
    letters = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage, longer = letters(196), letters(210)
    rows = [(i, letters(150) + (longer if i % 3 == 0 else passage) + letters(150)) for i in range(60)]
    got = suf.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), group_limit=5)
    want = cut_by_brute_force(rows)
    assert Counter(tuple(r) for r in got.collect()) == want and sum(x[2] > 0 for x in want) >= 20


def test_lines_of_repeated_ids(spark):
    rows = [(1, "a b c\nd e f"), (1, "a b c\nd e f\nq"), (1, "x\ny"), (2, "d e f\nx\nq\nz"), (1, "x\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in ld.line_dedup(docs, min_lines=1).collect())
    texts = Counter(t for (i, t), n in got.items() for _ in range(n) if i == 1)
    kept = Counter(line for t in set(texts) for line in t.split("\n") if line)
    assert got[2, "z"] == 1 and kept == Counter({"a b c": 1, "d e f": 1, "q": 1, "x": 1, "y": 1})
    assert sum(texts.values()) == 4 and texts["x\ny"] == 2


def test_longest_runs(spark):
    """Runs of every length by doubling to the end, against brute force."""
    rnd = random.Random(5)
    base = [f"l{i}" for i in range(70)]
    rows = []
    for i in range(40):
        j = rnd.randrange(70)
        rows.append((i, "\n".join([f"own {i}", *base[j : j + rnd.choice([1, 2, 3, 5, 13, 40])], f"end {i}"])))
    runs = ld.line_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=2).collect()
    got = {(r["doc_id"], k) for r in runs for k in range(r["lo"], r["hi"])}
    seen, want, longest = set(), set(), 0
    for i, t in rows:
        lines = t.split("\n")
        for k in range(len(lines) - 1):
            if (pair := tuple(lines[k : k + 2])) in seen:
                want |= {(i, k), (i, k + 1)}
            seen.add(pair)
    assert got == want
    by_doc = dict(rows)
    for r in runs:  # a run stands in an earlier document as a whole, or joins several that do
        longest = max(longest, r["hi"] - r["lo"])
        assert all(line in base for line in by_doc[r["doc_id"]].split("\n")[r["lo"] : r["hi"]])
    assert longest >= 20 and len({(r["doc_id"], r["lo"]) for r in runs}) == len(runs)


def test_jaccard_of_repeated_ids(spark):
    voc = [f"v{i}" for i in range(40)]
    a, b = " ".join(voc), " ".join(reversed(voc))
    rows = [(5, a), (5, b), (7, b + " more"), (8, a + " other"), (9, "all alone here"), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in nj.jaccard_join(docs).collect())
    assert got == Counter({(5, 5, 5, 1): 2, (7, 7, 5, 1): 1, (8, 8, 5, 1): 1, (9, 9, 9, 0): 1})
    assert Counter(r["doc_id"] for r in nj.keep_one(docs).collect()) == Counter({5: 3, 9: 1})


@pytest.mark.parametrize("runs", [2_000_000, 100])
def test_blocks_by_runs(spark, monkeypatch, runs):
    monkeypatch.setattr(nj, "BLOCK_RUNS", runs)
    rnd = random.Random(6)
    base = [f"b{rnd.randrange(99)}" for _ in range(120)]
    rows = [(i, " ".join([*base[: 60 + i], f"e{i}"])) for i in range(0, 60, 3)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    want = {i: sum(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets if j != i) for i in sets}
    assert {r["doc_id"]: r["n_links"] for r in nj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def bm25_shares(items, passage):
    """Each item's share of its own BM25 score that a set of words gets, without an index."""
    own = {i: dc.WORD.findall(t.lower()) for i, t in items}
    df, mean = Counter(w for x in own.values() for w in set(x)), sum(map(len, own.values())) / len(own)
    out = {}
    for i, x in own.items():
        parts = {w: np.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * n * (dc.K1 + 1) / (n + dc.K1 * (1 - dc.B + dc.B * len(x) / mean)) for w, n in Counter(x).items()}
        out[i] = sum(v for w, v in parts.items() if w in passage) / sum(parts.values())
    return out


def leaks_by_brute_force(docs, items):
    """Every passage against every item, each group of items by itself."""
    groups, want = {}, set()
    for k, text in items:
        if words := dc.WORD.findall((text or "").lower()):
            groups.setdefault(max(64, 2 ** int(np.ceil(np.log2(len(words))))), []).append((k, text))
    for step, own in groups.items():
        for i, t in docs:
            words = dc.WORD.findall((t or "").lower())
            for s in range(0, max(1, len(words) - step), step):
                passage = words[s : s + 2 * step]
                shares = bm25_shares(own, set(passage))
                for k, text in own:
                    if shares[k] >= 0.5:
                        overlaps = [len(g & dc.grams(passage, min(5, len(x)))) / len(g) for x in dc.split_item(text) for g in [dc.grams(x, 5)]]
                        want |= {(i, k)} if min(overlaps) >= 0.5 else set()
    return want


def test_a_long_item_changes_nothing_for_others(spark):
    rnd = random.Random(11)
    voc = [f"w{i}" for i in range(3000)]
    draw = lambda n: " ".join(rnd.choices(voc, k=n))
    items = [(i, f"{draw(20)}. {draw(8)}") for i in range(60)]
    long_ = (99, f"{draw(19_980)}. {draw(20)}")
    q, a = items[0][1].split(". ")
    docs = [(0, f"{q} {draw(5000)} {a}"), (1, f"{draw(300)} {items[1][1]} {draw(300)}"), (2, draw(2000)), (3, f"{draw(900)} {long_[1]}"), (4, long_[1][: len(long_[1]) // 3])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = [{tuple(r)[:2]: tuple(r)[2:] for r in dc.find_leaks(table, spark.createDataFrame(own, "item_id long, text string")).collect()} for own in (items, [*items, long_])]
    assert set(got[0]) == {(1, 1)} and {k: v for k, v in got[1].items() if k[1] != 99} == got[0] and {k for k in got[1] if k[1] == 99} == {(3, 99)}
    assert set(got[1]) == leaks_by_brute_force(docs, [*items, long_])
    words, spent = draw(200_000).split(), []
    for own in (items, [*items, long_]):
        groups = [(i, t, dc.length_group(len(t.split()))) for i, t in own]
        index = dc.Shards(groups, 5, {g: dc.Totals.of(t for _, t, h in groups if h == g) for g in {g for _, _, g in groups}}, 1000)
        start = time.process_time()
        index.leaks(words, 0.5)
        spent.append(time.process_time() - start)
    assert spent[1] < 4 * spent[0] + 0.5


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_leaks_by_brute_force(spark, at_once):
    rnd = random.Random(7)
    voc = [f"w{i}" for i in range(150)]
    items = [(i, " ".join(rnd.choice(voc) for _ in range(rnd.randrange(8, 30))) + ". " + " ".join(rnd.choice(voc) for _ in range(rnd.randrange(3, 9)))) for i in range(60)]
    docs = []
    for i in range(60):
        words = [rnd.choice(voc) for _ in range(rnd.randrange(200))]
        for _ in range(rnd.randrange(4)):
            own = rnd.choice(items)[1].split()
            at = rnd.randrange(len(words) + 1)
            words[at:at] = own[: rnd.randrange(len(own) * 4 // 5, len(own) + 1)]
        docs.append((i, " ".join(words)))
    docs += [(100, " ".join(rnd.choice(voc) for _ in range(30_000)) + " " + items[5][1]), (101, None), (101, ""), (0, docs[0][1])]
    want = leaks_by_brute_force(docs, items)
    schema = "doc_id long, text string, score int, item_id int, leaked int"
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], schema)
    got = dc.find_leaks(table, spark.createDataFrame(items, "item_id long, text string"), items_at_once=at_once)
    assert {tuple(r)[:2] for r in got.collect()} == want and len(want) >= 20 and (100, 5) in want
    if at_once == 1000:
        assert dc.find_leaks(table.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
        kept = dc.decontaminate(table, spark.createDataFrame(items, "item_id long, text string"))
        assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_lattice_scores_by_brute_force(spark):
    """The model's probability of each text from its definition, and that it sums to one."""
    pieces, weight = lm.load_pieces(lm.default_vocabulary())
    at = dict(zip(pieces, weight.tolist(), strict=True))
    assert sum(at.values()) == pytest.approx(1)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=lm.default_vocabulary())
    few = [(model.id_to_piece(i).replace("▁", " ").encode(), model.get_score(i)) for i in (300, 2000, 9000)]
    (a, x), (b, y), (c, z) = few
    assert at[a] / at[b] == pytest.approx((2.7 - y) / (2.7 - x)) and at[b] / at[c] == pytest.approx((2.7 - z) / (2.7 - y))

    def marginal(word):
        sums = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            sums[j] = sum(sums[i] * at.get(word[i:j], 0) for i in range(j))
        return sums[-1]

    rows = [(i, f"the cat sat on Mat {i % 5} {'und' * (i % 3)}") for i in range(30)] + [(100, None), (101, "unseen wörd the"), (101, "unseen wörd the")]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, score double, known_score string")
    train = [(i, t) for i, t in rows if i % 10]
    count = Counter(w for _, t in train for w in (t or "").lower().encode().split())
    ends, once, twice = len(train), sum(n == 1 for n in count.values()), sum(n == 2 for n in count.values())
    total = sum(count.values()) + ends + 2 * lm.PRIOR
    discount = (once + 0.5) / (once + 2 * twice + 1)
    spare, end = (discount * len(count) + lm.PRIOR) / total, (ends + lm.PRIOR) / total
    assert sum(n - discount for n in count.values()) / total + spare + end == pytest.approx(1)
    got = {r["doc_id"]: r for r in lm.score_texts(docs, "doc_id % 10 <> 0").collect()}
    copies = Counter(i for i, _ in rows)
    for i, t in rows:
        logs = {w: np.log10((count[w] - discount) / total * (w in count) + spare * marginal(b" " + w)) for w in (t or "").lower().encode().split()}
        words = (t or "").lower().encode().split()
        assert got[i]["score"] == pytest.approx(copies[i] * (sum(logs[w] for w in words) + np.log10(end)))
        assert got[i]["known_score"] == pytest.approx(copies[i] * (sum(logs[w] for w in words if w in count) + np.log10(end)))
    small = [b" a", b" ", b"a", b"b", b"ab"]
    logs = np.log([0.6, 0.2, 0.1, 0.05, 0.05])  # a first piece of 0.8, any number of others of 0.2
    lattice, mass = lm.Lattice(small), 0.0
    for n in range(12):
        words = np.array([list(b" " + bytes(97 + (k >> j & 1) for j in range(n))) for k in range(1 << n)], np.uint8)
        mass += np.exp(lattice.score(words, logs)).sum()
    assert mass == pytest.approx(1, abs=1e-5)


TITLE = "A title of it"
PARTS = ["The first paragraph has a number of words, and it ends well.", "Short one", "The last of the paragraphs says that all is said, so that it can end."]
ARTICLE = f"<h1>{TITLE}</h1>" + "".join(f"<p>{x}</p>" for x in PARTS)
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
FOOT = "<footer>&copy; 2020 Some site. All rights reserved.</footer>"
WRAPPERS = {
    "hidden in a name": '<div class="overflow-hidden">%s</div>',
    "hidden in a value": '<div data-note="no hidden fees">%s</div>',
    "with sidebar": '<div class="layout with-sidebar">%s</div>',
    "legal": '<section class="legal">%s</section>',
    "social": '<div class="social-issues"><main>%s</main></div>',
    "no widgets": '<div class="widget-area-none">%s</div>',
    "offset": '<div id="page-header-offset">%s</div>',
    "form around an article": '<form id="f"><article>%s</article></form>',
    "form around all": "<form>%s</form>",
    "hidden until shown": '<div style="display: none">%s</div>',
    "div soup": "<div><div>%s</div></div>",
    "comments": '<main><article>%s</article><section id="comments"><article class="comment"><p>I think that this is a very good text, and I liked it.</p></article><div class="comment-body"><p>So did I, though some of it seemed a bit long to me, honestly.</p></div></section></main>',
    "long comments": '<div class="post">%s</div><div id="disqus_thread">' + "<p>What a text, and what a lot of it there is to say, so here is more.</p>" * 30 + "</div>",
    "related and newsletter": '<div id="content"><div class="post">%s</div><div class="related-posts"><article><h3>Related</h3><p>Another story that is told by this site on other days.</p></article></div><aside><p>Join the newsletter, which comes each week with all that we wrote.</p></aside></div>',
    "cookies": '<div>%s</div><div class="cookie-banner"><p>We use cookies and other means in order to make this site better for you.</p><button>OK</button></div>',
    "advert within": f'<div class="story">%s<div class="ad-slot"><p>Buy this now, since it is a very good thing and costs but little, too.</p></div></div>',
    "scripts and a hidden part": '<article><script>var a = "</p><p>no text";</script>%s<p hidden>This is here, but nobody sees it on the page.</p><style>p { color: red }</style></article>',
    "table layout": '<table><tr><td class="sidebar"><a href="/x">One</a> <a href="/y">Two</a></td><td>%s</td></tr></table>',
}


@pytest.mark.parametrize("kind", WRAPPERS)
def test_wrappers(kind):
    page = f"<html><head><title>T</title></head><body>{MENU}{WRAPPERS[kind].replace('%s', ARTICLE)}{FOOT}</body></html>"
    assert hx.extract(page) == "\n".join([TITLE, *PARTS])


def test_article_head():
    head = f'<header class="entry-header"><h1>{TITLE}</h1></header>'
    assert hx.extract(f"{MENU}<article>{head}{ARTICLE[len(f'<h1>{TITLE}</h1>') :]}</article>{FOOT}") == "\n".join([TITLE, *PARTS])


def test_the_cut_decides():
    """Labels that the classifier alone has wrong: short lines in plain elements, and a sentence between menus."""
    long = "<div>This is a line of some length, which says one thing or another, and ends.</div>"
    short = "<div>And so</div>"
    links = "".join(f'<div><a href="/{k}">Link number {k}</a></div>' for k in range(6))
    page = f"<body><div>{links}<div>Read on here.</div>{links}</div><div><div>{long * 3}{short}{long * 2}{short}{long * 3}</div></div>{FOOT}</body>"
    found = hx.blocks(page)
    cut, alone = hx.labels(found)
    changed = {found[i][0]: cut[i] for i in range(len(found)) if cut[i] != alone[i]}
    assert changed.get("And so") is True and sum(x != y for x, y in zip(cut, alone, strict=True)) >= 2
    assert hx.extract(page) == "\n".join([long[5:-6]] * 3 + ["And so"] + [long[5:-6]] * 2 + ["And so"] + [long[5:-6]] * 3)
    changed_page = page.replace("Read on here.", "Here you can read on about all that.")
    found = hx.blocks(changed_page)
    cut, alone = hx.labels(found)
    at = [t for t, _, _ in found].index("Here you can read on about all that.")
    assert alone[at] and not cut[at]


def test_packing_leaves_no_words_in_its_worker(spark):
    """Python workers live on: what a task met must not stay beside the next step's memory."""
    import sys

    import pyarrow as pa

    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{k}" for k in range(50))) for i in range(40)], "doc_id long, text string")
    assert pk.pieces(docs.repartition(2), 64, pk.default_vocabulary()).count() >= 40

    def held(batches):
        list(batches)
        yield pa.record_batch([pa.array([len(x.known) for x in sys.modules["corvane_kept"].__dict__.values() if hasattr(x, "known")] if "corvane_kept" in sys.modules else [], pa.int64())], ["n"])

    got = [r["n"] for r in spark.range(4).repartition(4).mapInArrow(held, "n long").collect()]
    assert max(got, default=1) == 1  # the empty word


def test_pages_of_all_kinds(spark):
    long = MENU + "<article>" + "<p>One more paragraph of the long page, as there are many.</p>" * 20_000 + "</article>" + FOOT
    deep = "<div>" * 3000 + "<p>Text at the very bottom of it all, and a sentence too.</p>"
    assert hx.extract("<form>a b" * 20_000 + f"<article>{ARTICLE}</article>").endswith("\n".join([TITLE, *PARTS]))
    rows = [(1, "u", long, "t", 5, "x"), (2, "u", deep, None, None, None), (2, "u", deep, None, None, None), (3, None, "<<>&#x; <p", "t", 1, "x"), (None, "u", None, "t", 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, _0 string")
    got = Counter((r["page_id"], r["n_chars"]) for r in hx.extract_pages(pages).collect())
    line = len("One more paragraph of the long page, as there are many.")
    assert got[1, 20_000 * (line + 1) - 1] == 1 and got[2, 54] == 2 and sum(got.values()) == 5
    assert hx.extract_pages(pages.limit(0)).count() == 0


def test_vectors_of_an_id_that_crowds_the_bound(spark):
    """More rows of the query's own id reach its bound than are asked for: others are still found, in far cells too."""
    rng = np.random.default_rng(5)
    vectors = [(0, (np.array([3.0, 0, 0]) + rng.normal(size=3) / 100).tolist()) for _ in range(20)] + [(i, rng.normal(size=3).tolist()) for i in range(1, 41)]
    q = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in vectors]
    want = Counter()
    for v in {tuple(v) for i, v in q if i == 0}:
        best = sorted((-int(np.array(v) @ x), j) for j, x in q if j)[:5]
        want += Counter((0, k + 1, j, -s) for k, (s, j) in enumerate(best))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in vt.topk_join(df, pivots=30).collect()) == want


def test_regions_of_cells():
    """A query's copies are as many as regions, not as cells."""
    assert vt.regions_of(np.array([3, 0, 4, 9, 25, 1]), 10) == [([0, 2], 0, 1), ([3], 1, 1), ([4], 2, 3), ([5], 5, 1)]
    assert vt.regions_of(np.zeros(3, np.int64), 10) == []
    assert len(vt.regions_of(np.full(1024, 585), 12_500)) == 49


def test_vectors_of_repeated_ids_and_huge_components(spark):
    rng = np.random.default_rng(4)
    vectors = [(i % 150, rng.normal(size=5).tolist()) for i in range(200)]
    vectors += vectors[:3] + [(7, vectors[1][1])] * 60
    q = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in vectors]
    want = Counter()
    for i, v in {(i, tuple(v)) for i, v in q if i % 50 == 0}:
        best = sorted((-int(np.array(v) @ x), j) for j, x in q if j != i)[:5]
        want += Counter((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    schema = "vec_id long, embedding array<double>, v int, cell string, score double"
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in vectors], schema)
    for pivots in (None, 3):
        assert Counter(tuple(r) for r in vt.topk_join(df, pivots=pivots).collect()) == want
    large = spark.createDataFrame([(0, [1e6, 2e6], 1, "x", 2.0), (1, [-1e6, 3e6], 1, "x", 2.0)], schema)
    assert [r["score"] for r in vt.topk_join(large).collect()] == [256 * 256 * (6 * 10**12 - 10**12)]
    for x in (1e15, -1e30):
        with pytest.raises(ValueError, match="64 bits"):
            vt.topk_join(large.unionByName(spark.createDataFrame([(2, [x, 1.0], 1, "x", 2.0)], schema)))


def test_language_edge_cases(spark):
    rnd = random.Random(8)
    make = lambda letters, n=80: " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, make("abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz", 0.5, "x", 1) for i in range(40)]
    rows += [(50, make("abcde", 60_000), None, 0.5, "x", 1), (51, "", None, None, None, None), (1, rows[1][1], "aa", 0.5, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, _0 int")
    got = Counter((r["doc_id"], r["lang_pred"]) for r in li.identify(docs).collect())
    assert got[50, "aa"] == 1 and got[51, "und"] == 1 and got[1, "aa"] == 2 and sum(got.values()) == len(rows)
    kept = li.explained(docs)
    assert kept.columns == docs.columns and Counter(tuple(r) for r in kept.collect()) == Counter(r for r in rows if r[1])
    with pytest.raises(ValueError, match="languages"):
        li.identify(docs, max_languages=1)


def test_packing_repeated_rows(spark):
    rows = [(i % 9, f"a b {i % 9} " * (i % 9)) for i in range(60)] + [(1, None), (None, "x"), (3, "word " * 3000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, sequence_id long, length string")
    got = pk.pack(docs, capacity=64, with_ids=True).toPandas()
    assert got.groupby("sequence_id")["length"].sum().max() <= 64
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]]
    assert (got["piece"] == 0).sum() == len(rows) - 1 and (got["ids"].str.len() == 4 * got["length"]).all()


def test_tables_go_with_their_owner(spark, tmp_path):
    from pathlib import Path

    root = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")) / "corvane"
    docs = spark.createDataFrame(repeated_ids(3, n=30), "doc_id long, text string")
    before = {p for p in root.glob("*") if any(p.iterdir())}
    with common.owned():
        counted = [f(docs).count() for f in (sub.substring_dedup, suf.suffix_dedup, nj.jaccard_join, ld.line_dedup, lm.score_texts, pk.pack)]
    assert min(counted) > 0 and {p for p in root.glob("*") if any(p.iterdir())} == before


def test_pipeline_edges(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, class_id int"
    rnd = random.Random(9)
    make = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(60))
    rows = [(i, make(), "aa", "s", 1, 1.0, "x", 2) for i in range(20)]
    for name, own in (("some", rows), ("none", [])):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "quite other words than these")][: len(own)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = cp.run(spark, f"{tmp_path}/{name}").toPandas()
        assert sorted(got["doc_id"]) == sorted(r[0] for r in own)
        assert "ids" in got.columns and (got["ids"].str.len() == 4 * got["length"]).all()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(pk.default_vocabulary())
    tokens = {r["doc_id"]: r["ids"] for r in cp.run(spark, f"{tmp_path}/some").collect()}
    assert all(np.frombuffer(tokens[r[0]], "<u4")[:-1].tolist() == whole.encode(r[1], add_special_tokens=False).ids for r in rows)


BRIDGE = [
    "The council met on Tuesday to discuss the new bridge, which has been planned for over ten years.",
    "Some members asked for more time. Others said that the work had to begin at once, since the old bridge is no longer safe for lorries.",
    "It will be built by 2030.",
]
BRIDGE_HTML = f"<p>{BRIDGE[0]}</p><p>{BRIDGE[1]}</p><h2>What comes next</h2><p>{BRIDGE[2]}</p><ul><li>A first study</li><li>A call for offers</li></ul>"
TEMPLATES = {
    "wordpress": """<body class="home blog logged-in"><div id="page" class="site"><a class="skip-link screen-reader-text" href="#content">Skip to content</a><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">My Blog</a></p><p class="site-description">Just another site, as they say.</p></div><nav id="site-navigation" class="main-navigation"><ul><li><a href="/">Home</a></li></ul></nav></header><div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-1" class="post type-post"><header class="entry-header"><h1 class="entry-title">New bridge</h1></header><div class="entry-content">%s</div><footer class="entry-footer"><span class="cat-links">Posted in <a href="/c">News</a></span></footer></article><nav class="navigation post-navigation"><a href="/prev">Previous</a></nav><div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><p>I do not agree with the council at all, and I said so in the meeting that I went to last week.</p></article></li></ol><div id="respond"><form><p>Your email address will not be published.</p><textarea></textarea></form></div></div></main></div><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><p>This blog is written by two people who live in the town and like it.</p></section></aside></div><footer class="site-footer"><div class="site-info">Proudly powered by software of some kind.</div></footer></div></body>""",
    "bootstrap": """<body><div class="navbar navbar-default"><div class="container"><a class="navbar-brand" href="/">Town News</a></div></div><div class="container"><div class="row"><div class="col-md-8"><h1>New bridge</h1>%s</div><div class="col-md-4 sidebar"><div class="panel"><h3>About</h3><p>We are a small paper with a long history, and we write about all that goes on here.</p></div></div></div></div><div class="footer"><p>Copyright 2020 Town News, all rights reserved.</p></div></body>""",
    "news": """<body><div class="cookie-consent" role="dialog"><p>This site uses cookies. By going on you agree to their use as described in our policy.</p></div><header><div class="topbar"><a href="/login">Log in</a></div></header><div class="breadcrumbs"><a href="/">Home</a> / <a href="/n">News</a></div><div class="story"><h1>New bridge</h1><div class="share-buttons"><a href="#">Share</a></div><div class="story-body">%s</div><div class="advert">Advertisement<p>Get the best price for your car today, it only takes one minute of your time.</p></div></div><div class="recommended"><h3>More stories</h3><p>The mayor speaks about the budget for the coming year and what it holds.</p></div><footer><p>Terms of use and other things that nobody reads but that are here.</p></footer></body>""",
    "plain": """<html><body><h1>New bridge</h1>%s<hr><address>Webmaster</address></body></html>""",
    "table": """<body><table width=100%><tr><td colspan=2><a href="/">Home</a> | <a href="/a">Archive</a> | <a href="/c">Contact</a></td></tr><tr><td class="menu"><a href="/1">One</a><br><a href="/2">Two</a></td><td><h1>New bridge</h1>%s</td></tr><tr><td colspan=2>&copy; 2001 The Town</td></tr></table></body>""",
    "aspnet": """<body><form id="aspnetForm" method="post"><input type="hidden" name="x"><div id="header"><a href="/">Home</a></div><div id="main"><h1>New bridge</h1>%s</div><div id="footer">All rights reserved by the town council.</div></form></body>""",
    "notice": """<body><div class="alert alert-info">We have changed our opening hours. Please read about it on the page of the town hall.</div><main><h1>New bridge</h1>%s</main></body>""",
    "newsletter form": """<body><article><h1>New bridge</h1>%s<form class="newsletter"><p>Get our best stories by mail each morning, for free and without any advert.</p><input></form></article></body>""",
}


@pytest.mark.parametrize("kind", TEMPLATES)
def test_templates(kind):
    assert hx.extract(TEMPLATES[kind].replace("%s", BRIDGE_HTML)) == "\n".join(["New bridge", *BRIDGE[:2], "What comes next", BRIDGE[2], "A first study", "A call for offers"])
