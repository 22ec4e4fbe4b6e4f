"""Removal of byte strings that occur more than once (operator 9).

A sparse suffix array: of each 200-byte window only the winnowed anchor's suffix takes
part. Anchors whose seed occurs once anywhere cannot lie in a repeat and go. Anchors
whose whole surroundings (all that a window with this anchor can hold) occur again are
settled at once: these are the insides of copies. For the rest, one suffix for each
distinct surrounding is sorted by deep-shallow sorting: the seed is the bucket,
multikey quicksort on eight-byte characters goes to a shallow depth, and a blind trie
orders each group with a longer common prefix. The longest common prefixes to the right,
and those of the reversed text to the left, tell which windows around an anchor recur.

Scale: texts never meet in one place. Anchors, about one in 65 bytes, are counted with
map-side aggregation; a seed or surrounding of many rows is dealt over several tasks. A
seed with over ``group_limit`` distinct surroundings, too many for one sort, makes deeper
buckets first: two windows of ``length`` bytes around the seed agree either on half the
room more to its left or on half the room more to its right, so its rows go to the buckets
of these two longer strings, each for its half of the windows, and so on until buckets fit.
A bucket of whole windows needs no sort: its rows are equal.

Null texts are empty; texts under ``length`` bytes lose nothing; rows without an id take
no part. Rows that repeat an id count each: with the same text they are repeats of each
other, with different ones each is cut by its own. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import winnow
from .arrow import batch, binary, longs
from .common import Scratch, dealt_join, parts, texts, variant

SEED = 72
SHALLOW = 32
BUCKET_ROWS = 20_000


def multikey_groups(rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort byte rows by their first ``depth`` bytes: the order, and where equal groups begin.

    Multikey quicksort with characters of eight bytes: only rows that are still tied are
    partitioned by the next character.
    """
    m, width = rows.shape
    order, begins = np.arange(m), np.zeros(m, bool)
    if not m:
        return order, begins
    begins[0] = True
    for at in range(0, min(depth, width), 8):
        group = np.cumsum(begins)
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            break
        chars = np.zeros((len(tied), 8), np.uint8)
        part = rows[order[tied], at : min(at + 8, depth, width)]
        chars[:, : part.shape[1]] = part
        key = chars.view(">u8").ravel().astype(np.uint64)
        g = group[tied]
        by = np.lexsort((key, g))
        order[tied] = order[tied][by]
        key, g = key[by], g[by]
        begins[tied[1:][(key[1:] != key[:-1]) | (g[1:] != g[:-1])]] = True
    return order, begins


class BlindTrie:
    """Strings by the positions where they first differ; labels on edges are left out.

    A node is [depth, {byte: child}]; a leaf is a list of equal strings' numbers.
    """

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def add(self, k: int) -> None:
        s = self.strings[k]
        if self.root is None:
            self.root = (k,)
            return
        node, path = self.root, []
        while isinstance(node, list):  # blindly: bytes between branches are not looked at
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        while isinstance(node, list):
            node = next(iter(node[1].values()))
        other = self.strings[node[0]]
        depth = common_prefix(s, other)
        if depth == len(s):
            self._swap(path, s, node, (*node, k))
            return
        at = next((i for i, x in enumerate(path) if x[0] >= depth), len(path))
        if at < len(path) and path[at][0] == depth:
            path[at][1][s[depth]] = (k,)
            return
        below = path[at] if at < len(path) else self._child(path, s, node)
        new = [depth, {other[depth]: below, s[depth]: (k,)}]
        if at:
            path[at - 1][1][s[path[at - 1][0]]] = new
        else:
            self.root = new

    def _child(self, path: list, s: bytes, leaf: tuple):
        return path[-1][1].get(s[path[-1][0]], leaf) if path else leaf

    def _swap(self, path: list, s: bytes, old: tuple, new: tuple) -> None:
        if path:
            path[-1][1][s[path[-1][0]]] = new
        else:
            self.root = new

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(number, longest common prefix with the string before) in sorted order."""
        width = len(self.strings[0]) if self.strings else 0
        todo = [(self.root, 0)] if self.root else []
        while todo:
            node, lcp = todo.pop()
            if isinstance(node, tuple):
                for i, k in enumerate(node):
                    yield k, lcp if i == 0 else width
            else:
                children = [node[1][b] for b in sorted(node[1])]
                todo += [(c, node[0]) for c in children[:0:-1]]
                todo.append((children[0], lcp))


def common_prefix(a: bytes, b: bytes) -> int:
    """Of strings of one length."""
    if a == b:
        return len(a)
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows of one length and, in that order, each one's longest common
    prefix with the row before (-1 for the first)."""
    m, width = rows.shape
    order, begins = multikey_groups(rows, shallow)
    lcp = np.full(m, -1)
    edges = np.append(np.flatnonzero(begins), m)
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if e - s > 1:
            trie = BlindTrie([rows[i].tobytes() for i in order[s:e]])
            for k in range(e - s):
                trie.add(k)
            got = list(trie.ordered())
            order[s:e] = order[s:e][[k for k, _ in got]]
            lcp[s:e] = [x for _, x in got]
    heads = np.flatnonzero(begins)[1:]
    for at in range(0, len(heads), 1 << 16):
        h = heads[at : at + (1 << 16)]
        lcp[h] = (rows[order[h]] != rows[order[h - 1]]).argmax(1)
    return order, lcp


def recurring_windows(key: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of each surrounding recur: (row, window start's distance before the anchor).

    left: reversed bytes before the anchor; right: bytes from the anchor on; both padded.
    least, most: the distances that a row's bucket is for.
    A window with o bytes on the left recurs iff another row of the same key agrees on the
    first o bytes of left and the first length - o of right: iff it is in the same group of
    both suffix arrays, cut where the longest common prefix is under that depth.
    """
    m = len(key)
    by_key = np.unique(key, return_inverse=True)[1]
    sides = []
    for rows in (left, right):
        head = by_key.astype(">u8").view(np.uint8).reshape(m, 8)
        order, lcp = deep_shallow(np.hstack([head, rows]), 8 + SHALLOW + (SEED if rows is right else 0))
        sides.append((order, lcp - 8))
    out_row, out_o = [], []
    rank = np.empty(m, np.int64)
    for o in range(length - SEED + 1):
        fits = (n_left >= o) & (n_right >= length - o) & (least <= o) & (o <= most)
        if not fits.any():
            continue
        ids = []
        for (order, lcp), depth in zip(sides, (o, length - o), strict=True):
            rank[order] = np.cumsum(lcp < depth)
            ids.append(rank.copy())
        rows = np.flatnonzero(fits)
        both = ids[0][rows] * (m + 1) + ids[1][rows]
        _, at, n = np.unique(both, return_inverse=True, return_counts=True)
        hit = rows[n[at] > 1]
        out_row.append(hit)
        out_o.append(np.full(len(hit), o))
    return (np.concatenate(out_row), np.concatenate(out_o)) if out_row else (np.empty(0, np.int64), np.empty(0, np.int64))


def window_runs(row: np.ndarray, o: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged cover of windows: (row, lo, hi) from the anchor on. Windows of one anchor overlap, so the cover is one run."""
    if not len(row):
        return row, row, row
    by = np.argsort(row, kind="stable")
    row, o = row[by], o[by]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    return row[first], -np.maximum.reduceat(o, first), length - np.minimum.reduceat(o, first)


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        table = winnow.byte_values()
        for b in batches:
            ids, variants = longs(b.column(0)), longs(b.column(1))
            data, offsets = binary(b.column(2))
            for of, at, a, c in winnow.batch_anchors(data, offsets, SEED, length, lambda x: table[x]):
                yield batch(a=a.view(np.int64), c=c.view(np.int64), doc_id=ids[of], variant=variants[of], pos=at.astype(np.int32))

    return docs.select("doc_id", "variant", F.col("text").cast("binary").alias("text")).mapInArrow(run, "a long, c long, doc_id long, variant int, pos int")


def surroundings(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes around the wanted anchors (a, c, n, doc_id, variant, pos)."""
    by_doc = wanted.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("a", "c", "n", "pos")).alias("at"))
    joined = docs.select("doc_id", "variant", F.col("text").cast("binary").alias("text")).join(by_doc.hint("merge"), ["doc_id", "variant"])
    room = length - SEED

    def run(batches):
        for b in batches:
            out = []
            for doc, which, text, at in zip(*(b.column(x).to_pylist() if x != "text" else b.column(x) for x in ("doc_id", "variant", "text", "at")), strict=True):
                text = text.as_py()
                for x in at:
                    p = x["pos"]
                    out.append((x["a"], x["c"], x["n"], doc, which, p, text[max(0, p - room) : p][::-1], text[p : p + length]))
                if len(out) > 20_000:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

    def pack(out):
        a, c, n, doc, which, pos, left, right = zip(*out, strict=True)
        return batch(a=pa.array(a, pa.int64()), c=pa.array(c, pa.int64()), n=pa.array(n, pa.int64()), doc_id=pa.array(doc, pa.int64()), variant=pa.array(which, pa.int32()), pos=pa.array(pos, pa.int32()), before=pa.array(left, pa.binary()), after=pa.array(right, pa.binary()))

    return joined.mapInArrow(run, "a long, c long, n long, doc_id long, variant int, pos int, before binary, after binary")


def padded(values: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width)


def solve_bucket(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Deep-shallow sort all surroundings of some buckets; give the covers of unsettled ones."""
    n_left, n_right = pdf["before"].str.len().to_numpy(), pdf["after"].str.len().to_numpy()
    row, o = recurring_windows(pdf["bucket"].to_numpy(), padded(pdf["before"].tolist(), length - SEED), padded(pdf["after"].tolist(), length), n_left, n_right, pdf["least"].to_numpy(), pdf["most"].to_numpy(), length)
    row, lo, hi = window_runs(row, o, length)
    pos = pdf["pos"].to_numpy()[row].astype(np.int64)
    got = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[row], "variant": pdf["variant"].to_numpy()[row], "lo": pos + lo, "hi": pos + hi})
    return got[pdf["n"].to_numpy()[row] == 1]


def deeper(rows: DataFrame, length: int) -> DataFrame:
    """The rows of large buckets in the two buckets of half their windows each, by the longer strings that these have in common."""
    half = F.floor((F.col("least") + F.col("most")) / 2).cast("int")
    on_left = rows.withColumn("least", half + 1).where(F.length("before") >= F.col("least")).withColumn("bucket", F.xxhash64("bucket", F.lit(0), F.expr("substring(before, 1, least)")))
    on_right = rows.withColumn("most", half).where(F.length("after") >= length - F.col("most")).withColumn("bucket", F.xxhash64("bucket", F.lit(1), F.expr(f"substring(after, 1, {length} - most)")))
    return on_left.unionByName(on_right)


def sized_buckets(open_: DataFrame, scratch: Scratch, length: int, group_limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Buckets of at most group_limit rows to sort; and larger ones of one whole window each, with the rows' count."""
    todo, fit, whole, depth = open_, [], [], 0
    while True:
        sizes = scratch.keep(todo.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > group_limit), f"large{depth}")
        if sizes.isEmpty():
            return [*fit, todo], whole
        fit.append(todo.join(sizes.hint("merge"), "bucket", "left_anti"))
        large = dealt_join(todo, sizes, ["bucket"], "rows", ["doc_id", "pos"]).drop("rows")
        whole.append(large.where("least = most"))
        depth += 1
        todo = scratch.keep(deeper(large.where("least < most"), length), f"deeper{depth}")


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = 200, group_limit: int = 100_000) -> DataFrame:
    """(doc_id, variant, lo, hi): byte spans, possibly overlapping, whose union is all that recurs; hi may pass the text's end."""
    spark = docs.sparkSession
    anchors = scratch.keep(anchor_rows(docs, length), "anchors")
    shared = scratch.keep(anchors.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "shared")
    seen = scratch.keep(dealt_join(anchors, shared, ["a"], "k", ["doc_id", "pos"]).drop("k"), "seen")
    scratch.drop("anchors", "shared")
    same = seen.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "variant", "pos")).alias("at"))
    same = scratch.keep(same.select("a", "c", "n", "at.doc_id", "at.variant", "at.pos"), "same")
    settled = dealt_join(seen, same.where("n > 1").select("a", "c", "n"), ["a", "c"], "n", ["doc_id", "pos"])
    settled = settled.select("doc_id", "variant", F.greatest(F.col("pos") - (length - SEED), F.lit(0)).cast("long").alias("lo"), (F.col("pos") + length).cast("long").alias("hi"))
    # Where all surroundings of a seed but one recur as wholes, that one still has to be compared with a copy of each.
    kinds = same.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.max(F.when(F.col("n") == 1, 1).otherwise(0)).alias("open")).where("m > 1 and open = 1")
    kinds = scratch.keep(kinds.select("a", "m"), "kinds")
    open_ = surroundings(docs, dealt_join(same, kinds, ["a"], "m", ["c"]), length)
    open_ = scratch.keep(open_.withColumn("bucket", F.col("a")).withColumn("least", F.lit(0)).withColumn("most", F.lit(length - SEED)), "open")
    fit, whole = sized_buckets(open_, scratch, length, group_limit)
    spans = settled
    for some in fit:
        tasks = max(parts(spark), some.count() // BUCKET_ROWS + 1)
        spans = spans.unionByName(some.groupBy(F.pmod("bucket", F.lit(tasks))).applyInPandas(lambda pdf: solve_bucket(pdf, length), "doc_id long, variant int, lo long, hi long"))
    for some in whole:
        spans = spans.unionByName(some.where("n = 1").select("doc_id", "variant", (F.col("pos") - F.col("least")).cast("long").alias("lo"), (F.col("pos") - F.col("least") + length).cast("long").alias("hi")))
    return scratch.keep(spans, "spans")


def cut_spans(docs: DataFrame, spans: DataFrame, with_text: bool = False) -> DataFrame:
    """Each text without its spans, as counts and the SHA-256 of what is left (and the bytes left)."""
    by_doc = spans.groupBy("doc_id", "variant").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    joined = docs.select("doc_id", "variant", F.col("text").cast("binary").alias("text")).join(by_doc.hint("merge"), ["doc_id", "variant"], "left").drop("variant")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches):
        for b in batches:
            out = [[] for _ in range(5 + with_text)]
            for doc, text, lo, hi in zip(*b.columns, strict=True):
                text = text.as_py()
                runs, kept = 0, text
                if lo.is_valid and len(text):
                    s = np.maximum(lo.values.to_numpy(), 0)
                    e = np.minimum(hi.values.to_numpy(), len(text))
                    by = np.argsort(s, kind="stable")
                    s, e = s[by], np.maximum.accumulate(e[by])
                    new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                    begin, stop = s[new], e[np.append(new[1:] - 1, len(e) - 1)]
                    runs = len(new)
                    bounds = zip([0, *stop.tolist()], [*begin.tolist(), len(text)], strict=True)
                    kept = b"".join(text[x:y] for x, y in bounds)
                row = [doc.as_py(), len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest()] + [kept] * with_text
                for col, x in zip(out, row, strict=True):
                    col.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return joined.mapInArrow(run, schema)


def suffix_dedup(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, group_limit: int = 100_000) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else."""
    if length <= SEED:
        raise ValueError(f"length must be over {SEED}")
    docs = texts(docs, id_col, text_col).withColumn("variant", variant(F.col("text")))
    scratch = Scratch(docs.sparkSession, "suffix")
    spans = repeated_spans(docs, scratch, length, group_limit)
    scratch.drop("seen", "same", "kinds", "open")
    return cut_spans(docs, spans, with_text)
