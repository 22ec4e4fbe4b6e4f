"""Exact top-k inner products by a Voronoi join (operator 10).

Vectors belong to the cell of the nearest of some pivots, about the square root of their
number and at most ``MOST_PIVOTS``, taken by a hash of the vectors. Each cell's
summary (how many vectors, the range of their distances from the pivot, and the smallest
distances) is all that is known of it elsewhere. For a query q, a pivot p and a vector x
of its cell, q.x = q.p + q.(x - p) lies within |q||x - p| of q.p. So the summaries give a
score that k candidates surely reach, and cells whose upper bound stays below it hold no
answer: a query is sent only to the others, and solved there against the cell's vectors.

Scale: vectors are shuffled packed, in the smallest integers that hold them. Neighbours in
the list of cells make a region of at least ``block`` vectors and at most REGION_BYTES; a
larger cell is split over several. A query goes once to each region of which it needs a cell,
with a bit for each cell, and the queries are dealt into shares of at most ``query_block``; a
task holds one region and one share, so neither a hot cell, many copies of one vector nor many
queries make a large task, and it multiplies ROWS of each at a time. Only k rows for each query
and region leave it. Pivots and summaries are bounded. High-dimensional vectors without
structure give wide bounds; then most cells are needed, and the join is a scan in blocks.

Components become floor(scale * x), x as double. Vectors that are null, hold null or
non-finite components, or lack an id take no part. Vectors of each length are joined among
themselves, as products of different lengths are not defined. Components so large that a
product might leave the 64-bit integers are an error. An id that occurs twice stands for two
candidates of the others; as a query, each of its different vectors has its own ranks, and
no row of that id is a candidate. Other columns are ignored. No vectors, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import batch, binary, longs
from .common import Scratch

FEWEST_PIVOTS, MOST_PIVOTS = 64, 1024
REGION_BYTES = 8 << 20
#: Vectors, or queries, of one matrix product.
ROWS = 1024


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    good = good.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return good.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot and the distance to it."""
    own = (pivots * pivots).sum(1)
    cell = np.concatenate([(own - 2 * x[at : at + ROWS] @ pivots.T).argmin(1) for at in range(0, max(1, len(x)), ROWS)])
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def cells_needed(q: np.ndarray, pivots: np.ndarray, count: np.ndarray, far: np.ndarray, closest: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query, which cells may hold one of its k best, and a score that k vectors surely reach."""
    dot, size = q @ pivots.T, np.sqrt((q * q).sum(1))
    upper = dot + size[:, None] * far
    lower, weight = [], []
    for c, d in enumerate(closest):
        lower.append(dot[:, c : c + 1] - size[:, None] * d)
        weight.append(np.ones(len(d)))
    rest = dot - size[:, None] * far
    lower = np.concatenate([*lower, rest], axis=1)
    weight = np.concatenate([*weight, np.maximum(count - [len(d) for d in closest], 0)])
    lower, weight = lower[:, weight > 0], weight[weight > 0]
    few = min(k, len(weight))  # each stands for a vector at least, so the k highest do
    top = np.argpartition(-lower, few - 1, axis=1)[:, :few]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(lower, top, 1), axis=1), 1)
    reached = np.cumsum(weight[top], axis=1) >= k
    at = top[np.arange(len(q)), reached.argmax(1)]
    bound = np.where(reached.any(1), lower[np.arange(len(q)), at], -np.inf)
    bound -= 1e-6 * (1 + np.abs(bound))
    return (upper >= bound[:, None]) & (count > 0), bound


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(x.tobytes())])


def unpacked(column: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    return binary(column)[0].view(kind).reshape(len(column), width)


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k, self.n, self.least = k, np.zeros(queries, np.int64), least
        self.score, self.id = np.zeros((queries, k), np.int64), np.zeros((queries, k), np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        last = self.k - 1
        better = (self.n[row] < self.k) | (score > self.score[row, last]) | ((score == self.score[row, last]) & (ids < self.id[row, last]))
        row, score, ids = row[better], score[better], ids[better]
        own = np.unique(row)
        old, place = np.nonzero(np.arange(self.k) < self.n[own][:, None])
        row, score, ids = np.concatenate([own[old], row]), np.concatenate([self.score[own[old], place], score]), np.concatenate([self.id[own[old], place], ids])
        order = np.lexsort((ids, ~score, row))  # ~ turns the order and can't overflow
        row, score, ids = row[order], score[order], ids[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < self.k
        row, nth = row[keep], nth[keep]
        self.score[row, nth], self.id[row, nth] = score[keep], ids[keep]
        self.n[own] = np.bincount(np.searchsorted(own, row), minlength=len(own))
        full = own[self.n[own] == self.k]
        self.least[full] = np.maximum(self.least[full], self.score[full, last])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, nth = np.nonzero(np.arange(self.k) < self.n[:, None])
        return row, self.id[row, nth], self.score[row, nth]


def best_of_region(query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, wants: np.ndarray, ids: np.ndarray, cells: np.ndarray, x: np.ndarray, k: int, own: int, kind: type) -> Best:
    """Each query's k best in the cells that it wants of a region; no id occurs over ``own`` times as a query.

    Integer products are exact in the given kind; ROWS queries meet ROWS vectors at a time."""
    best, by = Best(len(q), k, least), np.lexsort((ids, cells))
    ids, cells, x = ids[by], cells[by], x[by]
    for c in np.unique(cells).tolist():
        first, end = np.searchsorted(cells, [c, c + 1]).tolist()
        asking = np.flatnonzero(wants[:, c])
        for a in range(first, end, ROWS):
            some, theirs = x[a : min(end, a + ROWS)].astype(kind).T, ids[a : min(end, a + ROWS)]
            for at in range(0, len(asking), ROWS):
                who = asking[at : at + ROWS]
                scores = q[who].astype(kind) @ some
                hits = scores >= best.least[who].astype(kind)[:, None]
                if len(theirs) > k + own and np.count_nonzero(hits) > 16 * k * len(who):
                    hits &= scores >= np.partition(scores, len(theirs) - k - own, axis=1)[:, [len(theirs) - k - own]]
                row, col = np.nonzero(hits)
                other = theirs[col] != query_ids[who[row]]
                row, col = row[other], col[other]
                if len(row):
                    best.add(who[row], scores[row, col].astype(np.int64), theirs[col])
    return best


def regions_of(counts: np.ndarray, size: int) -> list[tuple[list[int], int, int]]:
    """(cells, first region, regions): small cells share a region of at most about ``size`` vectors, a large one is split over several."""
    out, some, held, base = [], [], 0, 0
    for c in np.flatnonzero(counts).tolist():
        if some and held + counts[c] > size:
            out.append((some, base, max(1, -(-held // size))))
            base, some, held = base + out[-1][2], [], 0
        some, held = [*some, c], held + int(counts[c])
    return [*out, (some, base, max(1, -(-held // size)))] if some else out


def by_cell(values: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("cell")]


def topk_join(vectors: DataFrame, query_filter: str = "vec_id % 50 = 0", k: int = 5, scale: int = 256, pivots: int | None = None, block: int = 4096, query_block: int = 65_536, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with every other vector."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    all_ = quantised(vectors, id_col, vector_col, scale)
    out = None
    most = F.max(F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double")))
    for r in sorted(all_.groupBy(F.size("v").alias("dim")).agg(most.alias("most"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["dim"]):
        if r["dim"] and r["most"] ** 2 * r["dim"] >= 2**63:
            raise ValueError(f"components of {r['most']:g} after scaling: products of {r['dim']} of them do not fit 64 bits")
        few = pivots or min(MOST_PIVOTS, max(FEWEST_PIVOTS, int(r["n"] ** 0.5)))
        found = topk_of_length(all_.where(F.size("v") == r["dim"]), r["dim"], r["n"], r["most"] or 0.0, query_filter, k, few, block, query_block)
        out = found if out is None else out.unionByName(found)
    return empty if out is None else out


def topk_of_length(all_: DataFrame, dim: int, n: int, most: float, query_filter: str, k: int, pivots: int, block: int, query_block: int) -> DataFrame:
    """topk_join for quantised vectors of one length, of components up to ``most``."""
    spark = all_.sparkSession
    scratch = Scratch(spark, "voronoi")
    stored = np.dtype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)
    limit = int(most) ** 2 * dim + 1
    kind = np.float32 if limit < 2**24 else np.float64 if limit < 2**53 else np.int64
    one_in = max(1, n // (16 * pivots))
    sampled = lambda m: all_.where(F.pmod(F.xxhash64("v"), F.lit(m)) == 0).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    chosen = sampled(one_in) or sampled(1)
    centres = np.array([r["v"] for r in chosen], np.float64).reshape(len(chosen), dim)
    held = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for b in filter(len, batches):
            x = b.column(1).flatten().to_numpy().reshape(len(b), dim)
            cell, distance = nearest(x.astype(np.float64), held.value)
            yield batch(vec_id=b.column(0), v=packed(x.astype(stored)), cell=cell.astype(np.int32), distance=distance)

    dealt = scratch.keep(all_.mapInArrow(assign, "vec_id long, v binary, cell int, distance double"), "cells")
    first = F.row_number().over(Window.partitionBy("cell").orderBy("distance"))
    few = dealt.select("cell", "distance").groupBy("cell", "distance").agg(F.count(F.lit(1)).alias("n"))
    closest = few.withColumn("i", first).where(F.col("i") <= k + 1).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("distance", "n"))).alias("near"))
    summary = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).join(closest, "cell").collect()  # at most ``pivots`` rows
    count, far, near = np.zeros(len(centres), np.int64), np.zeros(len(centres)), [np.empty(0)] * len(centres)
    for r in summary:
        count[r["cell"]], far[r["cell"]] = r["n"], r["far"]
        near[r["cell"]] = np.repeat([x["distance"] for x in r["near"]], [min(x["n"], k + 1) for x in r["near"]])[: k + 1]
    bounds = spark.sparkContext.broadcast((count, far, near))

    queries = dealt.where(query_filter)
    own, asked = queries.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    cores, most_rows = spark.sparkContext.defaultParallelism, max(1, REGION_BYTES // max(1, dim * stored.itemsize))
    regions = regions_of(count, min(max(block, n // (4 * cores)), most_rows))
    shares = max(1, -(-asked // min(query_block, most_rows)))

    def send(batches):
        for b in batches:
            for at in range(0, len(b), ROWS):
                some = b.slice(at, ROWS)
                q = unpacked(some.column(1), stored, dim).astype(np.float64)
                parts = [cells_needed(q[i : i + 128], held.value, *bounds.value, k + own) for i in range(0, len(q), 128)]
                need, bound = (np.concatenate(x) for x in zip(*parts, strict=True))
                least = np.floor(np.maximum(bound, -float(limit))).astype(np.int64)
                for cells, base, split in regions:
                    rows = np.flatnonzero(need[:, cells].any(1))
                    if len(rows):
                        theirs, wants = some.take(pa.array(rows)), packed(np.packbits(need[np.ix_(rows, cells)], axis=1))
                        for i in range(split):
                            yield batch(region=np.full(len(rows), base + i, np.int32), query_id=theirs.column(0), which=theirs.column(2), q=theirs.column(1), least=least[rows], wants=wants)

    # A region's vectors meet each share of the queries that want one of its cells once.
    place = {c: i for cells, _, _ in regions for i, c in enumerate(cells)}
    base, split = ({c: r[j] for r in regions for c in r[0]} for j in (1, 2))
    hashed = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    region = (by_cell(base) + hashed("vec_id", by_cell(split))).cast("int")
    data = dealt.select(region.alias("region"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "vec_id", by_cell(place).alias("cell"), "v")
    single = queries.repartition(2 * cores, "vec_id", "v").dropDuplicates(["vec_id", "v"]).select("vec_id", "v", F.xxhash64("v").alias("which"))
    sent = single.mapInArrow(send, "region int, query_id long, which long, q binary, least long, wants binary").withColumn("share", hashed("query_id", F.lit(shares)))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        names, row, found = ["query_id", "which", "vec_id", "score"], np.empty(0, np.int64), [np.empty(0, np.int64)] * 2
        if left.num_rows and right.num_rows:
            wants = binary(left["wants"])[0].reshape(left.num_rows, -1)
            row, *found = best_of_region(
                longs(left["query_id"]), unpacked(left["q"], stored, dim), longs(left["least"]).copy(), np.unpackbits(wants, axis=1).view(bool), longs(right["vec_id"]), longs(right["cell"]), unpacked(right["v"], stored, dim), k, own, kind
            ).rows()
        ids, which = (longs(left[c])[row] if len(row) else row for c in ("query_id", "which"))
        return pa.table([ids, which, *found], names)

    found = sent.groupBy("region", "share").cogroup(data.groupBy("region", "share")).applyInArrow(solve, "query_id long, which long, vec_id long, score long")
    best = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
