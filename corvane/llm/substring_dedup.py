"""Removal of word runs that an earlier document also has (operator 4), by seed and extend.

Seeds are winnowed anchors of up to ``SEED`` words: each window of ``length`` words holds
one, and equal windows hold equal ones. Documents are joined on the seeds that lie in more
than one document. A seed is extended both ways for its whole group at once, not pair by
pair, since pairs grow with the square of a group of copies:

1. as far as any window with this seed can reach. Where a smaller document has the seed
   with the same surroundings, every window around it recurs, and the match goes on into
   the next seed;
2. at the open ends, for one representative of each of the other surroundings, word by
   word: the windows around the seed, up to length - seed + 1 of them, are matched by
   128-bit fingerprints with the smallest document that has them.

The matches around neighbouring seeds join into maximal repeats.

Scale: work and rows are linear in the anchors, about a quarter of the words. The anchors
are computed twice rather than written: once to count seeds in each task before the
shuffle, once to join those that documents share. A seed or surrounding of many rows is
dealt over several tasks. Each step's shuffle and tables go before the next one's.

Words are maximal runs outside ASCII white space, unchanged. Null texts are empty; texts
under ``length`` words lose nothing; rows without an id take no part; rows that repeat a
doc_id are cut each by its own text, none of them smaller than the other. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import winnow
from .arrow import batch, longs
from .common import Scratch, dealt_join, texts, variant

SEED = 6
KNOWN_WORDS = 400_000


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets all when full, so that its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def seed_words(length: int) -> int:
    return max(1, min(SEED, length // 2))


def anchor_rows(docs: DataFrame, length: int, counts: bool = False) -> DataFrame:
    """Each anchor's seed, surroundings and place; or of each seed the first and last document and the rows, in each task by chunks."""

    def run(batches):
        known = WordHashes()

        def flush(ids, variants, values):
            offsets, ids, variants = np.cumsum([0, *map(len, values)]), np.array(ids), np.array(variants, np.int32)
            for of, at, a, c in winnow.batch_anchors(np.concatenate(values), offsets, seed_words(length), length):
                a, doc = a.view(np.int64), ids[of]
                if not counts:
                    yield batch(a=a, c=c.view(np.int64), doc_id=doc, variant=variants[of], pos=at.astype(np.int32))
                elif len(a):
                    by = np.argsort(a, kind="stable")
                    begin = np.flatnonzero(np.append(True, a[by][1:] != a[by][:-1]))
                    yield batch(a=a[by][begin], first=np.minimum.reduceat(doc[by], begin), last=np.maximum.reduceat(doc[by], begin), n=np.diff(np.append(begin, len(a))).astype(np.int32))

        for b in batches:
            ids, variants, values, held = [], [], [], 0
            for doc, which, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids.append(doc)
                variants.append(which)
                values.append(known.of(text.as_py().split()))
                held += len(values[-1])
                if held > 400_000:
                    yield from flush(ids, variants, values)
                    ids, variants, values, held = [], [], [], 0
            if ids:
                yield from flush(ids, variants, values)

    schema = "a long, first long, last long, n int" if counts else "a long, c long, doc_id long, variant int, pos int"
    return docs.select("doc_id", "variant", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def windows_around(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The windows around the wanted seeds (a, c, doc_id, variant, pos): fingerprint and start, relative to the seed."""
    by_doc = wanted.groupBy("doc_id", "variant").agg(F.collect_list("a").alias("a"), F.collect_list("c").alias("c"), F.collect_list("pos").alias("pos"))
    joined = docs.select("doc_id", "variant", F.col("text").cast("binary").alias("text")).join(by_doc.hint("merge"), ["doc_id", "variant"])

    def run(batches):
        known = WordHashes()
        for b in batches:
            for doc, text, a, c, pos in zip(*(b.column(x) for x in ("doc_id", "text", "a", "c", "pos")), strict=True):
                values = known.of(text.as_py().split())
                if len(values) < length:
                    continue
                f1, f2 = (winnow.mix(winnow.Rolling(v).raw(length)) for v in (values, winnow.mix(values)))
                p = pos.values.to_numpy().astype(np.int64)
                back = np.arange(length - seed_words(length) + 1)
                start = p[:, None] - back
                row, o = np.nonzero((start >= 0) & (start < len(f1)) & (p[:, None] < len(values)))
                s = start[row, o]
                yield batch(a=a.values.to_numpy()[row], c=c.values.to_numpy()[row], o=o.astype(np.int32), f1=f1[s].view(np.int64), f2=f2[s].view(np.int64), doc_id=np.full(len(s), doc.as_py()))

    return joined.mapInArrow(run, "a long, c long, o int, f1 long, f2 long, doc_id long")


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = 13) -> DataFrame:
    """(doc_id, variant, lo, hi) in words, possibly overlapping: what recurs from a smaller document; hi may pass the text's end."""
    room, place = length - seed_words(length), ["doc_id", "variant", "pos"]
    shared = anchor_rows(docs, length, counts=True).groupBy("a").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    shared = scratch.keep(shared.where("first < last").select("a", "first", "n"), "shared")
    scratch.drop()
    seen = dealt_join(anchor_rows(docs, length), shared, ["a"], "n", ["doc_id", "pos"]).drop("n")
    seen = scratch.keep(seen, "seen")
    scratch.drop("shared")
    same = seen.groupBy("a", "c").agg(F.min(F.struct(*place)).alias("at"), F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    same = scratch.keep(same.select("a", "c", F.col("at.doc_id").alias("same_first"), "at.variant", "at.pos", "n", "first"), "same")
    # Surroundings whose first document is the seed's first too are where matches start; only the others can be open.
    joined = dealt_join(seen.where("doc_id > first").drop("first"), same.select("a", "c", "same_first", "n"), ["a", "c"], "n", ["doc_id", "pos"])
    joined = scratch.keep(joined.select("a", "c", "same_first", *place), "joined")
    wanted = same.join(same.where("same_first > first").select("a").distinct().hint("merge"), "a", "left_semi").select("a", "c", F.col("same_first").alias("doc_id"), "variant", "pos")
    wanted = scratch.keep(wanted, "wanted")
    scratch.drop("seen", "same")
    around = scratch.keep(windows_around(docs, wanted, length), "around")
    scratch.drop("wanted")
    firsts = around.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    firsts = scratch.keep(firsts.where("first < last").select("f1", "f2", "first", "n"), "firsts")
    scratch.drop()
    # All windows here hold one seed, so what they cover together is one run.
    hit = dealt_join(around, firsts, ["f1", "f2"], "n", ["c", "o"]).where("first < doc_id").groupBy("a", "c").agg(F.max("o").alias("far"), F.min("o").alias("near"))
    hit = scratch.keep(hit, "hit")
    scratch.drop("around", "firsts")
    settled = joined.where("same_first < doc_id").select("doc_id", "variant", F.greatest(F.col("pos") - room, F.lit(0)).cast("long").alias("lo"), (F.col("pos") + length).cast("long").alias("hi"))
    fitted = joined.where("same_first = doc_id").join(hit, ["a", "c"]).select("doc_id", "variant", (F.col("pos") - F.col("far")).cast("long").alias("lo"), (F.col("pos") - F.col("near") + length).cast("long").alias("hi"))
    spans = scratch.keep(settled.unionByName(fitted), "spans")
    scratch.drop("joined", "hit")
    return spans


def cut_spans(docs: DataFrame, spans: DataFrame, with_text: bool = False) -> DataFrame:
    """Each text without its spans of words: counts, SHA-256 of the words left, and the maximal spans."""
    by_doc = spans.groupBy("doc_id", "variant").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    joined = docs.select("doc_id", "variant", F.col("text").cast("binary").alias("text")).join(by_doc.hint("merge"), ["doc_id", "variant"], "left").drop("variant")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<lo: long, hi: long>>" + ", kept binary" * with_text
    span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, lo, hi in zip(*b.columns, strict=True):
                words = text.as_py().split()
                kept, cut = words, []
                if lo.is_valid and words:
                    delta = np.zeros(len(words) + 1, np.int64)
                    np.add.at(delta, np.maximum(lo.values.to_numpy(), 0), 1)
                    np.add.at(delta, np.minimum(hi.values.to_numpy(), len(words)), -1)
                    gone = np.cumsum(delta[:-1]) > 0
                    kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                    cut = [{"lo": int(x), "hi": int(y)} for x, y in edge.reshape(-1, 2)]
                left = b" ".join(kept)
                rows.append((doc.as_py(), len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), cut, left))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"][: 5 + with_text]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)][: len(names)], names)

    return joined.mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``length`` words that a document with a smaller id also has."""
    if length < 2:
        raise ValueError("length must be 2 or more")
    docs = texts(docs, id_col, text_col).withColumn("variant", variant(F.col("text")))
    scratch = Scratch(docs.sparkSession, "substring")
    return cut_spans(docs, repeated_spans(docs, scratch, length), with_text)
