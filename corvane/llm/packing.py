"""Best-fit packing of documents into sequences of a fixed number of tokens (operator 8).

Pattern packing: the histogram of piece lengths has at most ``capacity`` bins, whatever
the corpus, so the plan is made on the driver. Patterns of up to four lengths that fill a
sequence are enumerated; non-negative least squares fits how often each is used to the
histogram; the counts are rounded down to what is there; what is left over is packed by
best fit decreasing, run by run. The plan says for each run of pieces of one length (by
their number among the pieces of that length) which sequences and offset they take.

Scale: token ids are made by partition; only where they are returned are they shuffled,
once. Pieces are numbered within their length by salted groups, whose counts give each
group its first number, so a length that holds a third of all pieces is dealt over all
tasks. Groups and their counts are merge-joined, as they are dealt alike already; only the
plan is broadcast. Its rows are patterns of lengths, which the capacity bounds.

Null texts are empty: one piece with the end id alone. Rows without an id take no part;
rows that repeat an id are packed as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import batch, give_back, longs
from .common import Scratch, parts, texts
from .fast_bpe import encoder

END_ID = 1
SWEEPS = 20
ROW_GROUP = 32 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, capacity: int, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and end id, cut where longer than capacity."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        tokens, end = encoder(vocabulary), np.array([END_ID], "<u4").tobytes()

        def flush(ids, held):
            cols = [[] for _ in range(6)]
            for doc, data in zip(ids, tokens.encode(held), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for col, x in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)][: len(names)], names)

        for b in batches:
            ids, held, size = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(doc)
                held.append(text.as_py())
                size += len(held[-1])
                if size > 2_000_000:
                    yield flush(ids, held)
                    ids, held, size = [], [], 0
            if ids:
                yield flush(ids, held)
        tokens.forget()
        give_back()

    return docs.mapInArrow(run, schema)


def enumerate_patterns(count: np.ndarray, capacity: int, per_length: int = 3) -> list[tuple[int, ...]]:
    """Few-document patterns that fill a sequence or nearly so, from the lengths that occur."""
    there = np.flatnonzero(count)
    top = np.full(capacity + 1, 0)
    top[there] = there
    fit = np.maximum.accumulate(top)  # the largest occurring length up to each size
    found: set[tuple[int, ...]] = set()

    def best(room: int, k: int) -> list[int]:
        out = []
        while room > 0 and len(out) < k and fit[room]:
            out.append(int(fit[room]))
            room = out[-1] - 1
        return out

    for a in there.tolist():
        if a == capacity:
            found.add((a,))
        for b in best(capacity - a, per_length):
            found.add(tuple(sorted((a, b))))
        for share in (2, 3, 4):
            room = capacity - a
            for b in best(room // share, per_length):
                for c in best(room - b, 1):
                    found.add(tuple(sorted((a, b, c))))
                for c in best((room - b) // 2, 1):
                    for d in best(room - b - c, 1):
                        found.add(tuple(sorted((a, b, c, d))))
    return sorted(p for p in found if sum(p) <= capacity)


def non_negative_least_squares(patterns: list[tuple[int, ...]], count: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """How often each pattern is used: min |A x - count| with x >= 0, by coordinate descent."""
    x = [0.0] * len(patterns)
    order = sorted(range(len(patterns)), key=lambda j: (-sum(patterns[j]), j))
    columns = [np.unique(p, return_counts=True) for p in patterns]
    squares = [float((n * n).sum()) for _, n in columns]
    plain = [(j, at.tolist(), n.tolist(), squares[j]) for j in order for at, n in [columns[j]]]
    r = count.astype(float).tolist()
    for _ in range(sweeps):
        moved = 0.0
        for j, at, n, sq in plain:
            step = 0.0
            for i, k in zip(at, n, strict=True):
                step += k * r[i]
            new = x[j] + step / sq
            new = new if new > 0 else 0.0
            change = new - x[j]
            if change:
                x[j] = new
                for i, k in zip(at, n, strict=True):
                    r[i] -= k * change
                moved = max(moved, abs(change))
        if moved < 0.25:
            break
    return np.array(x)


def make_plan(count: np.ndarray, capacity: int) -> pd.DataFrame:
    """Runs (length, first, n, sequence, offset): the n pieces of this length from number ``first`` on go, one each, to sequences from ``sequence`` on."""
    left, used = count.astype(np.int64).copy(), np.zeros(len(count), np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (n, first sequence)
    sequences = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        rows.append((length, int(used[length]), n, sequence, offset))
        used[length] += n
        left[length] -= n

    patterns = enumerate_patterns(count, capacity)
    times = np.floor(non_negative_least_squares(patterns, count) + 1e-6).astype(np.int64)
    for p, n in zip(patterns, times.tolist(), strict=True):
        need = np.unique(p, return_counts=True)
        n = min([n, *(left[need[0]] // need[1]).tolist()])
        if n > 0:
            offset = 0
            for length in reversed(p):
                place(length, n, sequences, offset)
                offset += length
            if offset < capacity:
                room.setdefault(capacity - offset, []).append((n, sequences))
            sequences += n
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            fits = [r for r in room if r >= length]
            if not fits:
                per = capacity // length
                n = -(-int(left[length]) // per)
                room.setdefault(capacity, []).append((n, sequences))
                sequences += n
                continue
            r = min(fits)
            n, first = room[r].pop()
            if not room[r]:
                del room[r]
            per = min(r // length, -(-int(left[length]) // n)) if left[length] >= n else 1
            take = min(n, int(left[length]) // per)
            for k in range(per):
                place(length, take, first, capacity - r + k * length)
            if take < n:
                room.setdefault(r, []).append((n - take, first + take))
            if r - per * length:
                room.setdefault(r - per * length, []).append((take, first))
    return pd.DataFrame(rows, columns=["length", "first", "n", "sequence", "offset"])


def pack(docs: DataFrame, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece, with its sequence and its place there, gapless from 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    made = scratch.keep(pieces(texts(docs, id_col, text_col), capacity, vocabulary or default_vocabulary(), with_ids), "pieces", ROW_GROUP)
    salt = F.expr(f"pmod(xxhash64(doc_id, piece), {parts(spark)})")
    salted = made.withColumn("salt", salt)
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    groups = scratch.keep(groups.select("length", "salt", "n", F.coalesce("before", F.lit(0)).alias("before")), "groups")
    count = np.zeros(capacity + 1, np.int64)
    for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        count[r["length"]] = r["n"]
    plan = make_plan(count, capacity).sort_values(["length", "first"], ignore_index=True)
    held = spark.sparkContext.broadcast({k: plan[k].to_numpy() for k in plan})
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    numbered = salted.withColumn("k", number).join(groups.select("length", "salt", "before").hint("merge"), ["length", "salt"])
    numbered = numbered.select(*made.columns, (F.col("before") + F.col("k")).alias("k"))

    def run(batches):
        p = held.value
        starts = (p["length"] << 40) + p["first"]
        for b in batches:
            length, k = longs(b.column("length")), longs(b.column("k"))
            at = np.searchsorted(starts, (length << 40) + k, "right") - 1
            columns = {c: b.column(c) for c in b.schema.names if c != "k"}
            yield batch(**columns, sequence_id=p["sequence"][at] + k - p["first"][at], offset=p["offset"][at])

    return numbered.mapInArrow(run, f"{', '.join(f'{c} {t}' for c, t in made.dtypes)}, sequence_id long, offset long")
