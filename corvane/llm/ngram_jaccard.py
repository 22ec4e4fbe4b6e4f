"""N-gram Jaccard join with Bayesian candidate pruning (operator 2).

Documents are sets of hashed runs of ``ngram`` words (lower-cased letters and digits; a
shorter text is one run). Texts with the same set are one class, and only a class's
smallest document goes on. MinHash bands propose: classes that share a band form, through
all their bands, groups of candidates. Within a group MinHash values are compared ``STEP``
at a time, and a pair is dropped when the posterior probability that its similarity
reaches the threshold, under a uniform prior, is below ``tolerance``. The rest is verified
exactly, on the sets.

Scale: pairs are compared inside tasks and never emitted; what leaves a task is a link
count and at most one edge for each class. A group over ``BLOCK_ROWS`` classes, or whose
sets have over ``BLOCK_RUNS`` runs, is cut into blocks by hash, and each pair of blocks is
a task, so a hot group is spread and a task holds two blocks of bounded rows and bytes (or
two texts). Sets and signatures are shipped only for classes that share a band. Components
come from star contraction over written tables; nothing about documents reaches the driver.

The bands find a pair at the threshold with a probability over 0.9999 (27 bands of 5
values at 0.8: 1 - (1 - 0.8 ** 5) ** 27), more similar ones with higher.

Null and empty texts, and those without a letter or digit, have no runs: each is alone
and has no links. Rows that repeat an id with the same set are one document; with different
sets they are documents of their own, with a row each. Rows without an id take no part.
Other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batch
from .common import Scratch, texts, variant
from .winnow import mix

WORD = re.compile(r"[^\W_]+")
HASHES, BANDS, ROWS = 135, 27, 5
STEP = 15
BLOCK_ROWS, BLOCK_RUNS = 2048, 2_000_000
MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
SHIFTS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(1 << 32))


class WordNumbers(dict):
    """64-bit hashes of words, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, ngram: int, known: WordNumbers) -> np.ndarray:
    """Sorted distinct hashes of the runs of words."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(ngram, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits)."""
    least = np.full(HASHES, np.uint64(2**64 - 1))
    for at in range(0, len(s), 1 << 14):
        part = s[at : at + (1 << 14)]
        for k in range(0, HASHES, 45):
            got = (part[:, None] * MULTIPLIERS[None, k : k + 45] + SHIFTS[None, k : k + 45]).min(0)
            least[k : k + 45] = np.minimum(least[k : k + 45], got)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def fewest_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(n, m): after n values a pair with under m equal ones is dropped.

    With m of n equal and a uniform prior, the posterior of the similarity is
    Beta(m + 1, n - m + 1), and P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        for k in range(n + 2):
            total += math.exp(math.lgamma(n + 2) - math.lgamma(k + 1) - math.lgamma(n + 2 - k) + k * math.log(threshold) + (n + 1 - k) * math.log(1 - threshold))
            if total >= tolerance:
                m = k
                break
        out.append((n, m))
    return out


class Members:
    """Classes of one block: keys of their sets, documents in them, signatures and sets."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.assign(n=pdf["runs"].str.len() // 8).sort_values(["n", "key"], ignore_index=True)
        self.ids, self.copies, self.n = pdf["key"].to_numpy(), pdf["copies"].to_numpy(), pdf["n"].to_numpy()
        self.sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), HASHES)
        self.sets = [np.frombuffer(x, np.uint64) for x in pdf["runs"]]


def bitmaps(a: Members, b: Members) -> tuple[np.ndarray, np.ndarray]:
    """The sets of both as bits over the runs that at least two members have."""
    every = np.concatenate(a.sets + (b.sets if b is not a else []))
    runs, count = np.unique(every, return_counts=True)
    runs = runs[count > 1]
    out = []
    for own in (a,) if a is b else (a, b):
        bits = np.zeros((len(own.sets), max(1, -(-len(runs) // 64))), np.uint64)
        for i, s in enumerate(own.sets):
            at = np.searchsorted(runs, s)
            at = at[(at < len(runs)) & (runs[np.minimum(at, len(runs) - 1)] == s)] if len(runs) else at[:0]
            np.bitwise_or.at(bits[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        out.append(bits)
    return out[0], out[-1]


def linked(a: Members, b: Members, threshold: float, tolerance: float):
    """For each member of a, the members of b with Jaccard similarity of the threshold or more."""
    rule = fewest_matches(threshold, tolerance)
    bits_a = bits_b = None
    wide = None
    for i in range(len(a.ids)):
        lo = np.searchsorted(b.n, math.ceil(a.n[i] * threshold - 1e-9))
        hi = np.searchsorted(b.n, math.floor(a.n[i] / threshold + 1e-9), "right")
        if a is b:
            lo = max(lo, i + 1)
        at = np.arange(lo, hi)
        equal = np.zeros(len(at), np.int64)
        for n, least in rule:
            if not len(at):
                break
            equal += (b.sig[at, n - STEP : n] == a.sig[i, n - STEP : n]).sum(1)
            keep = equal >= least
            at, equal = at[keep], equal[keep]
        if not len(at):
            continue
        if wide is None:
            total = sum(map(len, a.sets)) + (0 if a is b else sum(map(len, b.sets)))
            wide = len(at) > 8 and total * (len(a.ids) + len(b.ids)) / 8 < 400e6
        if wide:
            if bits_a is None:
                bits_a, bits_b = bitmaps(a, b)
            both = np.bitwise_count(bits_b[at] & bits_a[i]).sum(1, dtype=np.int64)
        else:
            both = np.array([np.isin(b.sets[j], a.sets[i], assume_unique=True).sum() for j in at.tolist()], np.int64)
        yield i, at[both >= threshold * (a.n[i] + b.n[at] - both) - 1e-9]


def compare_blocks(pdf: pd.DataFrame, threshold: float, tolerance: float) -> pd.DataFrame:
    """Link counts of the members and a spanning forest of the links."""
    first, second = int(pdf["first"].iloc[0]), int(pdf["second"].iloc[0])
    a = Members(pdf[pdf["block"] == first])
    b = a if first == second else Members(pdf[pdf["block"] == second])
    ids = a.ids if a is b else np.concatenate([a.ids, b.ids])
    links, parent, shift = np.zeros(len(ids), np.int64), list(range(len(ids))), 0 if a is b else len(a.ids)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, at in linked(a, b, threshold, tolerance):
        links[i] += b.copies[at].sum()
        links[at + shift] += a.copies[i]
        for j in (at + shift).tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
    got = pd.DataFrame({"key": ids, "to": [ids[root(x)] for x in range(len(ids))], "links": links})
    return got[got["links"] > 0]


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, root): the smallest id of each connected component, for ids in edges (a, b).

    Large-star and small-star rounds, each over written tables, until nothing changes: the
    rounds grow with the logarithm of a component's size, and stars have a row for each id."""
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    k, before = 0, None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(own.select("a", F.col("m").alias("b"))).distinct()
        k += 1
        now = scratch.keep(small, f"{name}{k}")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{k - 1}")
        if state == before:
            break
        before = state
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")


def described(docs: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, variant, key of the set, number of runs, band keys) of each document."""

    def run(batches):
        known = WordNumbers()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                keys, sizes, bands = [], [], []
                for text in b.column("text")[at : at + 500]:
                    s = shingles(text.as_py(), ngram, known)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    bands.append(band_keys(signature(s)).view(np.int64))
                part = b.slice(at, 500)
                yield batch(doc_id=part.column("doc_id"), variant=part.column("variant"), key=pa.array(keys, pa.binary()), n=pa.array(sizes, pa.int64()), bands=pa.array(bands, pa.list_(pa.int64())))

    return docs.mapInArrow(run, "doc_id long, variant int, key binary, n long, bands array<long>")


def with_sets(docs: DataFrame, ngram: int) -> DataFrame:
    """(key, group, copies, blocks) with each class's signature and set, recomputed from its text."""

    def run(batches):
        known = WordNumbers()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = [shingles(t.as_py(), ngram, known) for t in part.column("text")]
                yield batch(**{c: part.column(c) for c in ("key", "group", "copies", "blocks")}, sig=pa.array([signature(s).tobytes() for s in sets], pa.binary()), runs=pa.array([s.tobytes() for s in sets], pa.binary()))

    return docs.select("key", "text", "group", "copies", "blocks").mapInArrow(run, "key binary, group binary, copies long, blocks int, sig binary, runs binary")


def classified(docs: DataFrame, scratch: Scratch, threshold: float, ngram: int, tolerance: float) -> DataFrame:
    """(doc_id, variant, copy_of, class_id, n_links) of docs (doc_id, variant, text)."""
    seen = scratch.keep(described(docs, ngram), "seen")
    filled = seen.where("n > 0")
    classes = filled.groupBy("key").agg(F.min(F.struct("doc_id", "variant")).alias("head"), F.count_distinct("doc_id").alias("copies"), F.min("n").alias("n"))
    classes = scratch.keep(classes.select("key", "head.doc_id", "head.variant", "copies", "n"), "classes")
    heads = filled.join(classes.select("key", "doc_id", "variant"), ["key", "doc_id", "variant"], "left_semi").dropDuplicates(["key"])
    banded = heads.select("key", F.explode("bands").alias("band"))
    stars = banded.groupBy("band").agg(F.min("key").alias("b"), F.max("key").alias("last")).where("b < last").select("band", "b")
    edges = banded.join(stars, "band").where("key <> b").select(F.col("key").alias("a"), "b").distinct()
    groups = components(scratch.keep(edges, "proposed"), scratch, "groups")
    groups = groups.unionByName(groups.select(F.col("root").alias("id"), "root").distinct())
    members = classes.join(groups.withColumnRenamed("id", "key"), "key")
    members = scratch.keep(members.withColumnRenamed("root", "group"), "members")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_RUNS)).cast("int").alias("blocks")
    members = members.join(members.groupBy("group").agg(blocks), "group").drop("n")
    held = docs.join(members.hint("merge"), ["doc_id", "variant"]).dropDuplicates(["key"])
    held = scratch.keep(with_sets(held, ngram), "held")
    dealt = held.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other", "blocks")
    got = dealt.groupBy("group", "first", "second").applyInPandas(lambda pdf: compare_blocks(pdf, threshold, tolerance), "key binary, to binary, links long")
    got = scratch.keep(got, "links")
    scratch.drop("proposed", "members", "held")
    roots = components(got.select(F.col("key").alias("a"), F.col("to").alias("b")), scratch, "roots")
    counts = got.groupBy("key").agg(F.sum("links").alias("links"))
    linked_ = classes.select("key", F.col("doc_id").alias("copy_of"), "copies").join(roots.withColumnRenamed("id", "key"), "key", "left").join(counts, "key", "left")
    linked_ = linked_.withColumn("root", F.coalesce("root", "key"))
    least = linked_.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    heads_out = linked_.join(least, "root").select("key", "copy_of", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = seen.select("doc_id", "variant", "key", "n").join(heads_out, "key", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", "variant", F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(~alone, F.col("key")).alias("key"))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, ngram: int = 5, tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, copy_of, class_id, n_links) of each document.

    copy_of: the smallest document with the same set; class_id: the smallest document that
    links lead to; n_links: how many other documents are within the threshold."""
    own = texts(docs, id_col, text_col).withColumn("variant", variant(F.col("text")))
    out = classified(own, Scratch(docs.sparkSession, "jaccard"), threshold, ngram, tolerance)
    return out.select("doc_id", "copy_of", "class_id", "n_links", "key").distinct().drop("key")


def keep_one(docs: DataFrame, threshold: float = 0.8, ngram: int = 5, tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the smallest of their class, with all their columns; rows without an id stay."""
    own = texts(docs, id_col, text_col).withColumn("variant", variant(F.col("text")))
    found = classified(own, Scratch(docs.sparkSession, "jaccard"), threshold, ngram, tolerance)
    gone = found.where("class_id < doc_id").select(F.col("doc_id").alias("__gone"), F.col("variant").alias("__variant")).distinct().hint("merge")
    return docs.join(gone, (docs[id_col].cast("long") == F.col("__gone")) & (variant(docs[text_col]) == F.col("__variant")), "left_anti")
