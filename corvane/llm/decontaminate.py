"""Benchmark decontamination by BM25 with block-max WAND (operator 1).

The test items are an inverted index: postings of (item, impact) in blocks of ``BLOCK``
items with each block's largest impact. Impacts are BM25's, as shares of the score that
the item gets from its own text, so that one threshold fits items of any length. Items
are grouped by length, up to ``LEAST`` words, up to twice as many, and so on. Each group is
a collection of its own, with its document frequencies, mean length and passages, so a long
item changes nothing for short ones. Every passage of every document (twice the group's
length, by steps of it) is a query; all items that reach the threshold are retrieved, by
document-at-a-time block-max WAND. Before that, a bound for each block of items, from the
block maxima of all words of the passage, leaves out the passages that no block can lift
over the threshold; it is summed for many passages of a document at once.

A retrieved item is a leak if enough of the n-grams of its question and of its answer
occur in the passage. The answer is the item's last sentence, or its last third where it
has one sentence; n is ``ngram`` or, for shorter parts, all their words.

Scale: one pass over the documents, no shuffle of text, for up to ``ITEM_BYTES`` of items,
which are broadcast with the frequencies of their words; a larger benchmark takes more
passes, with the same results. Postings and block maxima are flat arrays, of what occurs
only. An index holds ``items_at_once`` items; a document's words are numbered once and then
looked up in each index. Frequencies are counted by Spark, and only those of a pass's words
are collected. Results are a few rows for each leak, combined by (document, item).

Words are lower-cased runs of letters and digits. Null and empty texts match nothing, as
do items without words; rows or items without an id take no part; items that repeat an id
count as one with the better match. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Hashable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import give_back
from .common import texts

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
K1, B = 1.2, 0.75
BLOCK = 4
#: Words of the items of the first group; each further group's are twice as long.
LEAST = 64
ITEM_BYTES = 16_000_000


def split_item(text: str) -> tuple[list[str], list[str]]:
    """The words of question and answer."""
    parts = [w for s in SENTENCE.split(text.lower()) if (w := WORD.findall(s))]
    if len(parts) > 1:
        return [w for s in parts[:-1] for w in s], parts[-1]
    words = parts[0] if parts else []
    cut = max(1, len(words) * 2 // 3)
    return words[:cut], words[cut:]


def length_group(words: int) -> int:
    """The most words of an item's group."""
    return max(LEAST, 1 << (words - 1).bit_length())


def grams(words: Sequence[Hashable], n: int) -> set[tuple]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Totals:
    """What scores take from all items of a group."""

    def __init__(self, n: int, words: int, df: dict[str, int]):
        self.n, self.words, self.df = n, words, df

    @classmethod
    def of(cls, texts: Iterable[str]) -> Totals:
        own = [q + a for q, a in map(split_item, texts) if q]
        return cls(len(own), sum(map(len, own)), Counter(w for x in own for w in set(x)))


class Index:
    """Inverted index of items of one group, for the retrieval of all items over a share of their own score."""

    def __init__(self, items: list[tuple[int, str]], ngram: int, totals: Totals, step: int):
        rows = [(i, *split_item(t)) for i, t in items]
        rows = [(i, q, a) for i, q, a in rows if q]
        self.step, self.ngram, self.ids, self.cuts = step, ngram, [i for i, _, _ in rows], [len(q) for _, q, _ in rows]
        self.number: dict[str, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number)) for w in q + a], np.int32) for _, q, a in rows]
        mean, idf = totals.words / max(1, totals.n), np.zeros(len(self.number))
        for w, i in self.number.items():
            idf[i] = math.log(1 + (totals.n - totals.df[w] + 0.5) / (totals.df[w] + 0.5))
        word, item, impact = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0)]
        for k, own in enumerate(self.words):
            w, n = np.unique(own, return_counts=True)
            x = idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(own) / mean))
            word, item, impact = [*word, w], [*item, np.full(len(w), k, np.int32)], [*impact, x / x.sum()]
        word, self.item, self.impact = np.concatenate(word), np.concatenate(item), np.concatenate(impact)
        order = np.lexsort((self.item, word))
        word, self.item, self.impact = word[order], self.item[order], self.impact[order]
        self.start = np.searchsorted(word, np.arange(len(self.number) + 1))
        self.blocks = max(1, -(-len(rows) // BLOCK))
        # Maxima of the blocks in which a word occurs, word by word.
        new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (self.item[1:] // BLOCK != self.item[:-1] // BLOCK))) if len(word) else np.empty(0, np.int64)
        self.block, self.block_max = self.item[new] // BLOCK, np.maximum.reduceat(self.impact, new) if len(new) else np.empty(0)
        self.block_start = np.searchsorted(word[new], np.arange(len(self.number) + 1))
        self.opened: dict[int, tuple[list[int], list[float], float, dict[int, float]]] = {}
        self.grams_of: dict[int, list[tuple[set, int]]] = {}

    def postings(self, w: int) -> tuple[list[int], list[float], float, dict[int, float]]:
        """Items, impacts, the largest impact, and that of each block."""
        if w not in self.opened:
            a, b, c, d = self.start[w], self.start[w + 1], self.block_start[w], self.block_start[w + 1]
            impact = self.impact[a:b].tolist()
            self.opened[w] = self.item[a:b].tolist(), impact, max(impact), dict(zip(self.block[c:d].tolist(), self.block_max[c:d].tolist(), strict=True))
        return self.opened[w]

    def retrieve(self, words: Iterable[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose share of their own score from these distinct words reaches the threshold: block-max WAND."""
        lists = [[p[0][0], 0, w, *p] for w in words for p in [self.postings(w)]]
        found = []
        while lists:
            lists.sort(key=lambda x: x[:3])
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += x[5]
                if bound >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(x[6].get(block, 0.0) for x in lists[: pivot + 1]) < threshold - 1e-6:
                # No item up to the block's end, or the next list's item, can reach the threshold.
                target = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    target = min(target, lists[pivot + 1][0])
                self.advance(lists, pivot + 1, max(target, item + 1))
            elif lists[0][0] == item:
                score = sum(x[4][x[1]] for x in lists[: pivot + 1])
                if score >= threshold - 1e-9:
                    found.append((item, score))
                self.advance(lists, pivot + 1, item + 1)
            else:
                self.advance(lists, pivot, item)
        return found

    def advance(self, lists: list, n: int, target: int) -> None:
        """Move the first n lists to their first item from target on; ended lists go."""
        for row in lists[:n]:
            own = row[3]
            row[1] = bisect_left(own, target, row[1])
            row[0] = own[row[1]] if row[1] < len(own) else -1
        lists[:] = [row for row in lists if row[0] >= 0]

    def bounds(self, ids: np.ndarray, passages: int) -> np.ndarray:
        """The highest sum of block maxima, over each passage's distinct words, of any block."""
        step, width = self.step, len(self.number)
        at = np.flatnonzero(ids < width)
        of = at // step  # the passage that begins in this step; the one before holds the word too
        key = np.concatenate([of * width + ids[at], ((of - 1) * width + ids[at])[of > 0]])
        key = np.unique(key[key < passages * width])
        word, of = key % max(1, width), key // max(1, width)
        n = self.block_start[word + 1] - self.block_start[word]
        entry = np.repeat(self.block_start[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        sums = np.bincount(np.repeat(of, n) * self.blocks + self.block[entry], self.block_max[entry], passages * self.blocks)
        return sums.reshape(passages, self.blocks).max(1)

    def parts(self, item: int) -> list[tuple[set, int]]:
        """The n-grams of an item's question and answer, and their n."""
        if item not in self.grams_of:
            own = self.words[item].tolist()
            self.grams_of[item] = [(grams(x, self.ngram), min(self.ngram, len(x))) for x in (own[: self.cuts[item]], own[self.cuts[item] :]) if x]
        return self.grams_of[item]

    def leaks(self, ids: np.ndarray, threshold: float) -> list[tuple[int, float, float, float]]:
        """(item, score, question overlap, answer overlap) of all passages of a document; ids: its words' numbers, the largest for those of no item."""
        step, none = self.step, len(self.number)
        starts = np.arange(0, max(1, len(ids) - step), step)
        at_once = max(1, min(256, (1 << 21) // self.blocks, (1 << 20) // step))  # bounded memory on long texts
        best: dict[int, tuple[float, float, float]] = {}
        for base in range(0, len(starts), at_once):
            own = starts[base : base + at_once]
            for s in own[self.bounds(ids[own[0] : own[-1] + 2 * step], len(own)) >= threshold - 1e-4].tolist():
                passage = ids[s : s + 2 * step].tolist()
                hits = self.retrieve(set(passage) - {none}, threshold)
                there: dict[int, set] = {}
                for item, score in hits:
                    shares = []
                    for own_grams, n in self.parts(item):
                        if n not in there:
                            there[n] = grams(passage, n) if len(passage) >= n else set()
                        shares.append(len(own_grams & there[n]) / len(own_grams))
                    row = (score, shares[0], shares[-1])
                    if item not in best or min(row[1:]) > min(best[item][1:]) or (min(row[1:]) == min(best[item][1:]) and row > best[item]):
                        best[item] = row
        return [(self.ids[k], *row) for k, row in best.items()]


class Shards:
    """Indexes of at most ``size`` items of one group each, with one numbering of all their words."""

    def __init__(self, items: list[tuple[int, str, int]], ngram: int, totals: dict[int, Totals], size: int):
        groups: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for i, text, group in items:
            groups[group].append((i, text))
        own = [Index(some[at : at + size], ngram, totals[group], group) for group, some in sorted(groups.items()) for at in range(0, len(some), size)]
        self.number = {w: i for i, w in enumerate(sorted({w for x in own for w in x.number}))}
        self.own = []
        for x in own:
            local = np.full(len(self.number) + 1, len(x.number))
            local[[self.number[w] for w in x.number]] = list(x.number.values())
            self.own.append((x, local))

    def leaks(self, words: list[str], threshold: float) -> list[tuple[int, float, float, float]]:
        get, last = self.number.get, len(self.number)
        ids = np.fromiter((get(w, last) for w in words), np.int64, len(words))
        return [row for x, local in self.own for row in x.leaks(local[ids], threshold)]


def measured(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Items with words: their group, how many words they have, and which."""
    for b in batches:
        rows = []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            q, a = split_item(text)
            if q:
                rows.append((i, text, length_group(len(q) + len(a)), len(q) + len(a), sorted({*q, *a})))
        if rows:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())], strict=True)], ["item_id", "text", "group", "n", "words"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5, ngram: int = 5, items_at_once: int = 4096, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each leaked item in each document."""
    spark = docs.sparkSession
    own = texts(docs, id_col, text_col)
    items = texts(benchmark, item_col, item_text_col).where("text <> ''").mapInArrow(measured, "item_id long, text string, group long, n long, words array<string>")
    sizes = items.groupBy("group").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("words"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row for each power of two
    passes = max(1, -(-sum(r["bytes"] for r in sizes) // ITEM_BYTES))
    found_words = lambda rows: rows.select("group", F.explode("words").alias("word"))
    df = found_words(items).groupBy("group", "word").agg(F.count(F.lit(1)).alias("df"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for k in range(passes):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        rows = sorted((r["item_id"], r["text"], r["group"]) for r in some.select("item_id", "text", "group").collect())
        known: dict[int, dict[str, int]] = defaultdict(dict)
        for r in (df.join(found_words(some).distinct(), ["group", "word"], "left_semi") if passes > 1 else df).collect():
            known[r["group"]][r["word"]] = r["df"]
        held = spark.sparkContext.broadcast((rows, {r["group"]: Totals(r["items"], r["words"], known[r["group"]]) for r in sizes}))

        def run(batches, held=held):
            index = Shards(held.value[0], ngram, held.value[1], items_at_once)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
            for b in batches:
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    found = index.leaks(WORD.findall(text.as_py().lower()), threshold) if index.own else ()
                    rows += [(doc, *x) for x in found if min(x[2:]) >= overlap]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            index = None
            give_back()

        found = own.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct(F.least("question_overlap", "answer_overlap").alias("o"), "score", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.question_overlap", "best.answer_overlap")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without a leaked item, with all their columns; rows without an id stay."""
    leaked = find_leaks(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(leaked, docs[id_col].cast("long") == F.col("__leaked"), "left_anti")
