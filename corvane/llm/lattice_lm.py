"""Language-model scores by subword lattices (operator 7).

The pieces of an existing subword vocabulary form a unigram model. Its scores are ranks
(0, -1, -2, ...), and a piece of score s weighs 1 / (2.7 - s), the Zipf-Mandelbrot law, so
that all weights together are 1; this is the one map from scores to weights. A word's
probability is the sum over all its segmentations: the forward recursion in log space over
the lattice of pieces, weighed by these scores. A word seen in training has one
segmentation more, the word as a whole, which weighs its frequency less an absolute
discount; the discounted mass goes to the lattice. A text's probability is the product
over its words and one end token. ``rounds`` refits the weights to the training words by
expectation-maximisation; by default they stay as the vocabulary has them.

All words of one length are taken at once in numpy; of a word over ``LONG_WORD`` bytes,
all positions, so that numpy is called for each length of a piece and not for each edge.
Work on the lattice is for each distinct word of the corpus, not for each occurrence.

Scale: words are counted in each task before the shuffle. The scored words are a table
that grows with the corpus, so it is joined, not broadcast; only the most frequent words
(at most ``frequent``, found from a histogram of counts) are broadcast, which takes hot
keys out of the join. Piece counts are bounded by the vocabulary.

Null text is empty and has the end token only. Rows without an id take no part; rows
that repeat an id are scored as one. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import winnow
from .arrow import batch, binary, longs
from .common import Scratch, texts

PRIOR = 0.1
CHUNK_WORDS = 400_000
LATTICE_CELLS = 1 << 20
LONG_WORD = 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def lowered(text: bytes) -> list[bytes]:
    """Words: A-Z lower-cased, cut at ASCII white space (bytes.lower and bytes.split do just this)."""
    return text.lower().split()


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a word's first with a space before, and weights from their scores; every byte is a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece and b" " not in piece[1:]:
            found.setdefault(piece, 1 / (2.7 - model.get_score(i)))
    least = min(found.values(), default=1.0)
    for b in range(256):
        found.setdefault(bytes([b]), least / 10)
    weight = np.array(list(found.values()))
    return list(found), weight / weight.sum()


class Lattice:
    """Log-probabilities of pieces, by a hash of their bytes."""

    BITS = 18

    def __init__(self, pieces: list[bytes]):
        self.table, self.longest = winnow.byte_values(), max(map(len, pieces))
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(i)
        keys = np.zeros(len(pieces), np.uint64)
        for n, own in by_length.items():
            sums, q = self.sums(np.frombuffer(b"".join(pieces[i] for i in own), np.uint8).reshape(len(own), n))
            keys[own] = self.key(sums, q, 0, n)
        self.slots, self.which, self.steps = np.zeros((1 << self.BITS) + 256, np.uint64), np.full((1 << self.BITS) + 256, -1), 1
        for i, key in enumerate(keys.tolist()):
            slot = key >> (64 - self.BITS)
            step = 0
            while self.which[slot + step] >= 0:
                step += 1
            self.slots[slot + step], self.which[slot + step] = key, i
            self.steps = max(self.steps, step + 1)

    def sums(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, q = winnow.powers(words.shape[1] + 1)
        out = np.zeros((len(words), words.shape[1] + 1), np.uint64)
        np.cumsum(self.table[words] * p[: words.shape[1]], axis=1, out=out[:, 1:])
        return out, q

    def key(self, sums: np.ndarray, q: np.ndarray, i: int, j: int) -> np.ndarray:
        return winnow.mix((sums[:, j] - sums[:, i]) * q[i] + np.uint64(j - i))

    def find(self, key: np.ndarray) -> np.ndarray:
        slot = (key >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.where(self.slots[slot] == key, self.which[slot], -1)
        more = np.flatnonzero((out < 0) & (self.which[slot] >= 0))
        for step in range(1, self.steps):
            if not len(more):
                break
            at = slot[more] + step
            hit = (self.slots[at] == key[more]) & (self.which[at] >= 0)
            out[more[hit]] = self.which[at[hit]]
            more = more[~hit & (self.which[at] >= 0)]
        return out

    def edges(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(i, j, rows, pieces): the rows whose bytes i to j are a piece, in order of j."""
        sums, q = self.sums(words)
        out = []
        for j in range(1, words.shape[1] + 1):
            for i in range(max(0, j - self.longest), j):
                piece = self.find(self.key(sums, q, i, j))
                rows = np.flatnonzero(piece >= 0)
                if len(rows):
                    out.append((i, j, rows, piece[rows]))
        return out

    def forward(self, words: np.ndarray, logs: np.ndarray, edges) -> np.ndarray:
        alpha = np.full((words.shape[1] + 1, len(words)), -np.inf)
        alpha[0] = 0
        for i, j, rows, piece in edges:
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + logs[piece])
        return alpha

    def long_edges(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The edges of one word, in order of their ends: starts, ends and pieces."""
        sums, q = self.sums(word[None, :])
        found = []
        for size in range(1, min(self.longest, len(word)) + 1):
            n = len(word) - size + 1
            piece = self.find(winnow.mix((sums[0, size:] - sums[0, :n]) * q[:n] + np.uint64(size)))
            start = np.flatnonzero(piece >= 0)
            found.append((start, start + size, piece[start]))
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((start, end))
        return start[by], end[by], piece[by]

    @staticmethod
    def long_sums(edges: list[tuple[int, int, float]], n: int, first: int) -> list[float]:
        """Of n + 1 places, the log of the summed weights of all ways from the first one along the edges."""
        out = [-math.inf] * (n + 1)
        out[first] = 0.0
        for a, b, x in edges:
            x += out[a]
            y = out[b]
            out[b] = x if y == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
        return out

    def long_forward(self, word: np.ndarray, logs: np.ndarray, edges) -> list[float]:
        start, end, piece = edges
        return self.long_sums(list(zip(start.tolist(), end.tolist(), logs[piece].tolist(), strict=True)), len(word), 0)

    def long_expected(self, word: np.ndarray, count: float, logs: np.ndarray) -> np.ndarray:
        start, end, piece = edges = self.long_edges(word)
        alpha = np.array(self.long_forward(word, logs, edges))
        beta = np.array(self.long_sums(list(zip(end[::-1].tolist(), start[::-1].tolist(), logs[piece[::-1]].tolist(), strict=True)), len(word), len(word)))
        return np.bincount(piece, np.exp(alpha[start] + logs[piece] + beta[end] - alpha[-1]) * count, len(logs))

    def score(self, words: np.ndarray, logs: np.ndarray) -> np.ndarray:
        if words.shape[1] > LONG_WORD:
            return np.array([self.long_forward(w, logs, self.long_edges(w))[-1] for w in words])
        return self.forward(words, logs, self.edges(words))[-1]

    def expected(self, words: np.ndarray, count: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Expected piece counts by forward and backward recursion."""
        if words.shape[1] > LONG_WORD:
            return sum(self.long_expected(w, n, logs) for w, n in zip(words, count.tolist(), strict=True))
        edges = self.edges(words)
        alpha = self.forward(words, logs, edges)
        beta = np.full(alpha.shape, -np.inf)
        beta[-1] = 0
        for i, j, rows, piece in reversed(edges):
            beta[i, rows] = np.logaddexp(beta[i, rows], beta[j, rows] + logs[piece])
        out = np.zeros(len(logs))
        which = np.concatenate([piece for *_, piece in edges])
        share = np.concatenate([np.exp(alpha[i, rows] + logs[piece] + beta[j, rows] - alpha[-1, rows]) * count[rows] for i, j, rows, piece in edges])
        out += np.bincount(which, share, len(logs))
        return out


def by_length(data: np.ndarray, offsets: np.ndarray):
    """Words of one length as byte rows with a space before: (their numbers, rows), in bounded groups."""
    lengths = np.diff(offsets)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.append(True, lengths[order][1:] != lengths[order][:-1])) if len(order) else []
    for s, e in zip(edges, np.append(edges[1:], len(order)).astype(int), strict=True):
        n = int(lengths[order[s]])
        step = max(1, LATTICE_CELLS // (n + 1) ** 2)
        for at in range(s, e, step):
            own = order[at : min(at + step, e)]
            rows = np.full((len(own), n + 1), 32, np.uint8)
            rows[:, 1:] = data[offsets[own][:, None] + np.arange(n)]
            yield own, rows


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, all): occurrences in training texts and in all texts, summed in each task by chunks."""

    def run(batches):
        def flush(train, other):
            more = [w for w in other if w not in train]
            words, c = [*train, *more], [*train.values(), *[0] * len(more)]
            n = [k + other.get(w, 0) for w, k in zip(words, c, strict=True)]
            return batch(word=pa.array(words, pa.binary()), c=pa.array(c, pa.int64()), n=pa.array(n, pa.int64()))

        train, other = Counter(), Counter()  # of texts to learn from, and of the others
        for b in batches:
            for text, own in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                (train if own else other).update(lowered(text.as_py()))
                if max(len(train), len(other)) > CHUNK_WORDS:
                    yield flush(train, other)
                    train, other = Counter(), Counter()
        if train or other:
            yield flush(train, other)

    counted = docs.select(F.col("text").cast("binary").alias("text"), "train").mapInArrow(run, "word binary, c long, n long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit_pieces(words: DataFrame, vocabulary: str, rounds: int) -> np.ndarray:
    """Log-probabilities of the pieces, after EM over all training words, each once."""
    spark = words.sparkSession
    pieces, weight = load_pieces(vocabulary)
    logs = np.log(weight)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(logs)

        def run(batches, held=held):
            lattice, sums = Lattice(load_pieces(vocabulary)[0]), np.zeros(len(held.value))
            for b in batches:
                for _, rows in by_length(*binary(b.column(0))):
                    sums += lattice.expected(rows, np.ones(len(rows)), held.value)
            at = np.flatnonzero(sums)
            yield batch(piece=at.astype(np.int32), n=sums[at])

        got = words.where("c > 0").select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
        count = np.full(len(pieces), PRIOR)
        count[got["piece"]] += got["n"]
        logs = np.log(count / count.sum())
    return logs


class Numbers(dict):
    """Numbers of words; ``missing`` for all others, which are not kept."""

    missing = -1

    def __missing__(self, word: bytes) -> int:
        return self.missing


def score_texts(docs: DataFrame, training: Column | str = "true", id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, rounds: int = 0, frequent: int = 300_000) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, known_score) of every text; learns from rows where ``training`` holds.

    known_score: the part of the score that is of tokens seen in training."""
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    scratch = Scratch(spark, "lattice")
    own = texts(docs, id_col, text_col).withColumn("train", F.coalesce(F.expr(training) if isinstance(training, str) else training, F.lit(False)))
    words = scratch.keep(count_words(own), "words")
    ends = own.where("train").count()
    once, twice = F.count(F.when(F.col("c") == 1, 1)).alias("once"), F.count(F.when(F.col("c") == 2, 1)).alias("twice")
    totals = words.agg(F.sum("c").alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), once, twice).first()
    n, v = (totals["c"] or 0) + ends, totals["v"] + (ends > 0)
    discount = (totals["once"] + 0.5) / (totals["once"] + 2 * totals["twice"] + 1)
    spare = (discount * totals["v"] + PRIOR) / (n + 2 * PRIOR)  # the lattice's share of all tokens
    end = float(np.log((ends + PRIOR) / (n + 2 * PRIOR)))
    logs = fit_pieces(words, vocabulary, rounds)
    floor = np.log10(n + PRIOR * (v + 1))
    end_base = float(np.log10(ends + PRIOR) - floor)
    held = spark.sparkContext.broadcast(logs)

    def rate(batches):
        lattice = Lattice(load_pieces(vocabulary)[0])
        for b in batches:
            score = np.zeros(b.num_rows)
            for at, rows in by_length(*binary(b.column(0))):
                score[at] = lattice.score(rows, held.value)
            c = longs(b.column(1))
            whole = np.log(np.maximum(c - discount, 1e-300) / (n + 2 * PRIOR))
            score = np.where(c > 0, np.logaddexp(whole, np.log(spare) + score), np.log(spare) + score)
            yield batch(word=b.column(0), n=b.column(2), known=(c > 0).astype(np.int64), base=np.log10(c + PRIOR) - floor, score=score / np.log(10))

    rated = scratch.keep(words.select("word", "c", "n").mapInArrow(rate, "word binary, n long, known long, base double, score double"), "rated")
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    histogram = sorted(((r["level"], r["k"]) for r in rated.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, total = 1 << 30, 0
    for at, k in histogram:
        if (total := total + k) > frequent:
            break
        least = at
    known = rated.where(level >= least).select("word", "known", "base", "score").collect()  # at most ``frequent`` rows
    values_ = np.array([[r["known"], r["base"], r["score"], r["score"] * r["known"]] for r in known], float).reshape(-1, 4)
    top = spark.sparkContext.broadcast(([bytes(r["word"]) for r in known], values_))
    del known

    def look_up(batches):
        names, values = top.value
        index = Numbers(zip(names, range(len(names)), strict=True))
        values = np.vstack([values, np.zeros((1, 4))])
        missing = index.missing = len(names)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "word", "n", "known", "base", "score", "known_score"])

        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = lowered(text.as_py())
                at = np.fromiter(map(index.__getitem__, own), np.int64, len(own))
                known_, base, score, known_score = values[at].sum(0).tolist()
                rows.append((doc, None, len(own) + 1, int(known_) + (ends > 0), base + end_base, score + end / np.log(10), known_score + (ends > 0) * end / np.log(10)))
                rare = np.flatnonzero(at == missing).tolist()
                rows += [(doc, w, k, 0, 0.0, 0.0, 0.0) for w, k in Counter([own[i] for i in rare]).items()]
                if len(rows) > 100_000:
                    yield flush(rows)
                    rows = []
            if rows:
                yield flush(rows)

    found = scratch.keep(own.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(look_up, "doc_id long, word binary, n long, known long, base double, score double, known_score double"), "found")
    rare = found.where("word is not null").select("doc_id", "word", F.col("n").alias("k"))
    rare = rare.join(rated.where(level < least).drop("n"), "word")
    rare = rare.select("doc_id", F.lit(0).cast("long").alias("n"), (F.col("known") * F.col("k")).alias("known"), (F.col("base") * F.col("k")).alias("base"), (F.col("score") * F.col("k")).alias("score"), (F.col("score") * F.col("known") * F.col("k")).alias("known_score"))
    both = found.where("word is null").drop("word").unionByName(rare)
    out = both.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"), F.sum("known_score").alias("known_score"))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "known_score")
