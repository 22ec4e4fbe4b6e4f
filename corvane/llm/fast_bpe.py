"""Token ids of many whole texts with a given BPE tokenizer file.

White space separates tokens in these vocabularies, so a text is the sequence of its
words, and each distinct word is encoded once while it is remembered. Words of Latin
letters, with or without plain punctuation behind, are encoded by merging all distinct
words of a batch at once in numpy; anything else goes to the tokenizer itself, as do
words of over ``LONG_WORD`` characters, since each merge in numpy passes over the whole
word. The merges of a word end with the same ids whichever of the two applies them.
"""

from __future__ import annotations

import json
import re
import sys
import types

import numpy as np

PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
KNOWN_WORDS = 300_000
LONG_WORD = 100


def byte_letters() -> list[str]:
    """The printable stand-ins for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Merges:
    """Pair -> (rank, merged id), as an open-addressing table over numpy arrays."""

    BITS = 20

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left, right, new = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        keys, self.steps = (left << 20) | right, 0
        size = 1 << self.BITS
        self.keys, self.rank, self.new = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int32), np.zeros(size + 64, np.int32)
        for rank, (slot, key, n) in enumerate(zip(self.slot(keys).tolist(), keys.tolist(), new.tolist(), strict=True)):
            step = 0
            while self.keys[slot + step] != -1:
                step += 1
            self.keys[slot + step], self.rank[slot + step], self.new[slot + step] = key, rank, n
            self.steps = max(self.steps, step + 1)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[f"{x}</w>"] for x in letters], np.int64)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key in the table, or -1."""
        slot = self.slot(key)
        there = self.keys[slot]
        out = np.where(there == key, slot, -1)
        more = np.flatnonzero((out < 0) & (there >= 0))
        for step in range(1, self.steps):
            if not len(more):
                break
            there = self.keys[slot[more] + step]
            hit = there == key[more]
            out[more[hit]] = slot[more[hit]] + step
            more = more[~hit & (there >= 0)]
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids, as little-endian 32-bit bytes, of words without white space."""
        data = np.frombuffer(("\n".join(words) + "\n").encode(), np.uint8)
        stops = np.flatnonzero(data == 10)
        lengths = np.diff(np.append(-1, stops)) - 1
        data, ends = data[data != 10], np.cumsum(lengths)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        none = np.int32(2**31 - 1)
        while len(symbols):
            key = (symbols[:-1] << 20) | symbols[1:]
            at = self.find(key)
            at[word[:-1] != word[1:]] = -1
            rank = np.append(np.where(at >= 0, self.rank[at], none), none)
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(begin, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, begin), size)
            over = best == none
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            first = np.flatnonzero((rank == best) & ~over)
            first = first[np.append(True, word[first][1:] != word[first][:-1])] if len(first) else first
            symbols[first] = self.new[at[first]]
            over[first + 1] = True
            symbols, word = symbols[~over], word[~over]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        by = np.argsort(word, kind="stable")
        flat, stops = symbols[by].astype("<u4").tobytes(), (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops, strict=False)]


class Known(dict):
    """word -> ids. A word not known gets an empty bytearray, to be filled in place, and is noted."""

    def __init__(self):
        super().__init__({"": b""})
        self.new: dict[str, bytearray] = {}

    def __missing__(self, word: str) -> bytearray:
        made = self[word] = self.new[word] = bytearray()
        return made


class Encoder:
    """Whole texts to ids. Memory is bounded: the words known are forgotten when there are too many."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self.known, self.tails = Known(), {"": b""}

    def slow(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.whole.encode_batch(words, add_special_tokens=False)]

    def learn(self) -> None:
        known, new = self.known, self.known.new
        whole, odd, cut = [], [], []
        for w in new:
            if len(w) > LONG_WORD:
                odd.append(w)
            elif w.isalpha() and PLAIN.fullmatch(w):
                whole.append(w)
            elif m := PLAIN.fullmatch(w):
                cut.append((w, *m.groups()))
            else:
                odd.append(w)
        for w, ids in zip(odd, self.slow(odd) if odd else (), strict=True):
            new[w] += ids
            known[w] = ids
            if len(w) > LONG_WORD:  # not remembered, as their number does not bound their size
                del known[w]
        for tail in {t for _, _, t in cut} - self.tails.keys():
            self.tails[tail] = self.slow([tail])[0]
        stems = whole + [s for _, s, _ in cut]
        ids = self.merges.encode("\n".join(stems).lower().split("\n")) if stems else []
        for w, x in zip(whole, ids, strict=False):
            new[w] += x
            known[w] = x
        for (w, _, tail), x in zip(cut, ids[len(whole) :], strict=True):
            new[w] += x + self.tails[tail]
            known[w] = x + self.tails[tail]
        new.clear()
        if len(self.tails) > 10_000:
            self.tails = {"": b""}

    def forget(self) -> None:
        """Words and tails; the vocabulary stays."""
        self.known, self.tails = Known(), {"": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_WORDS:
            self.known = Known()
        get = self.known.__getitem__
        found = [list(map(get, t.replace("\n", " ").replace("\t", " ").split(" "))) for t in texts]
        if self.known.new:
            self.learn()
        return [b"".join(x) for x in found]


def encoder(path: str) -> Encoder:
    """One for each Python process and vocabulary, as it takes a while to read; each task forgets the words that it met."""
    box = sys.modules.setdefault("corvane_kept", types.ModuleType("corvane_kept")).__dict__
    if path not in box:
        box[path] = Encoder(path)
    return box[path]
