"""Centroid clustering with Hamerly's bounds, in exact integers (operator 11).

Lloyd's rounds over integer vectors: components become floor(scale * x), x as double. Each
vector keeps, from round to round, its cluster, an upper bound of the distance to its
centroid and one lower bound of the distance to the second nearest. When centroids move,
the upper bound grows by the own centroid's drift and the lower one shrinks by the largest
drift of the others. A vector whose upper bound stays under the lower bound, or under half
the way from its centroid to the next, keeps its cluster. For the others the distance to
the own centroid is taken anew, and where that does not decide, all centroids are scanned,
in exact integers, ties to the smaller number. Bounds are rounded away from each other and
compared strictly, so ties never slip through.

Scale: a round is one pass over a written table, without a shuffle of vectors. Tasks write
the vectors' new state and, beside it, what their moved vectors add to and take from the
centroids' sums: at most ``k`` rows a task, summed on the JVM. The driver holds ``k`` sums,
a number that does not grow with the data. Nothing is keyed by cluster, so a hot cluster or
many copies of a vector make no large task. A lost executor costs the tasks of one round.

Vectors that are null, have another length than ``dim``, hold null or non-finite components
or lack an id take no part. Fewer vectors than ``k``: each starts a cluster. Rows that repeat
an id are vectors of their own; as first centroids their order is that of their components.
A cluster that loses all vectors keeps its centroid and has no row. Components so large that
a squared distance might leave the 64-bit integers are an error. Other columns are ignored.
No vectors, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

GUARD = 1e-12
STATE = "vec_id long, v array<long>, cluster int, upper double, lower double, moved array<long>"
FINAL = "vec_id long, cluster int, distance long, moved array<long>"


def whole_vectors(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their integer components."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(float)  # null becomes NaN
    bad = np.append(0, np.cumsum(~np.isfinite(x)))
    end = np.cumsum(n)
    fit = (n == dim) & (bad[end] == bad[end - n])
    x = np.floor(scale * x[np.repeat(fit, n)]).reshape(-1, dim)
    if x.size and 4.0 * dim * float(np.abs(x).max()) ** 2 >= 2**63:
        raise ValueError("components are too large: squared distances would leave the 64-bit integers")
    return fit, x.astype(np.int64)


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All squared distances, exact: in doubles where every sum stays below 2 ** 53, else in 64-bit integers."""
    most = max((float(np.abs(a).max()) for a in (x, centroids) if a.size), default=0.0)
    kind = np.float64 if 4.0 * x.shape[1] * most**2 < 2**53 else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    return ((a * a).sum(1)[:, None] + (c * c).sum(1) - 2 * (a @ c.T)).astype(np.int64)


def own_squares(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    d = x - centroids[cluster]
    return (d * d).sum(1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper and lower bound of vectors of which nothing is known."""
    d = squares(x, centroids)
    cluster = d.argmin(1)  # the first of equals
    upper = np.sqrt(d[np.arange(len(x)), cluster])
    d[np.arange(len(x)), cluster] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1)) if len(centroids) > 1 else np.full(len(x), np.inf)
    return cluster.astype(np.int32), upper * (1 + GUARD), lower * (1 - GUARD)


class Step:
    """Centroids before and after a move, and what bounds take from it."""

    def __init__(self, before: np.ndarray, now: np.ndarray):
        self.centroids = now
        self.drift = np.sqrt(((now - before) ** 2).sum(1)) * (1 + GUARD)
        most, next_ = np.append(np.sort(self.drift)[::-1], 0.0)[:2]
        self.others = np.where(self.drift == most, next_ if (self.drift == most).sum() == 1 else most, most)
        between = squares(now, now)
        np.fill_diagonal(between, np.iinfo(np.int64).max)
        self.half = np.sqrt(between.min(1)) / 2 * (1 - GUARD) if len(now) > 1 else np.full(1, np.inf)

    def update(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cluster, by = cluster.copy(), self.others[cluster]
        upper, lower = (upper + self.drift[cluster]) * (1 + GUARD), np.where(np.isinf(lower), lower, lower - by - GUARD * (np.abs(lower) + by))
        bound = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(upper >= bound)
        upper[open_] = np.sqrt(own_squares(x[open_], self.centroids, cluster[open_])) * (1 + GUARD)
        open_ = open_[upper[open_] >= bound[open_]]
        if len(open_):
            cluster[open_], upper[open_], lower[open_] = scan(x[open_], self.centroids)
        return cluster, upper, lower


def lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def sums_of(rows: DataFrame, width: int) -> dict[int, np.ndarray]:
    """The tasks' sums by cluster: a row for each cluster."""
    told = rows.where("moved is not null").groupBy("cluster").agg(*[F.sum(F.col("moved")[i]).alias(f"s{i}") for i in range(width)])
    return {r["cluster"]: np.array(r[1:], np.int64) for r in told.collect()}


def first_state(centroids: np.ndarray, dim: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        moved = np.zeros((len(centroids), dim + 1), np.int64)
        for b in batches:
            fit, x = whole_vectors(b.column(1), dim, scale)
            if len(x):
                cluster, upper, lower = scan(x, centroids)
                add(moved, cluster, x, 1)
                yield state(b.column(0).filter(pa.array(fit)), x, cluster, upper, lower)
        yield from told(moved, dim)

    return run


def next_state(step: Step, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        moved = np.zeros((len(step.centroids), dim + 1), np.int64)
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, dim)
            was, upper, lower = (b.column(i).to_numpy() for i in (2, 3, 4))
            cluster, upper, lower = step.update(x, was, upper, lower)
            at = np.flatnonzero(cluster != was)
            add(moved, was[at], x[at], -1)
            add(moved, cluster[at], x[at], 1)
            yield state(b.column(0), x, cluster, upper, lower)
        yield from told(moved, dim)

    return run


def last_state(step: Step, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        inertia = np.zeros(len(step.centroids), np.int64)
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, dim)
            cluster, _, _ = step.update(x, *(b.column(i).to_numpy() for i in (2, 3, 4)))
            d = own_squares(x, step.centroids, cluster)
            np.add.at(inertia, cluster, d)
            yield pa.record_batch([b.column(0), pa.array(cluster), pa.array(d), pa.nulls(len(d), pa.list_(pa.int64()))], ["vec_id", "cluster", "distance", "moved"])
        n = len(inertia)
        yield pa.record_batch([pa.nulls(n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.nulls(n, pa.int64()), lists(inertia[:, None])], ["vec_id", "cluster", "distance", "moved"])

    return run


def add(moved: np.ndarray, cluster: np.ndarray, x: np.ndarray, sign: int) -> None:
    np.add.at(moved, cluster, sign * np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1))


NAMES = ["vec_id", "v", "cluster", "upper", "lower", "moved"]


def state(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([ids, lists(x), pa.array(cluster), pa.array(upper), pa.array(lower), pa.nulls(len(x), pa.list_(pa.int64()))], NAMES)


def told(moved: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    """What a task's moved vectors change in the sums."""
    at = np.flatnonzero(moved.any(1))
    if len(at):
        none = pa.nulls(len(at), pa.float64())
        yield pa.record_batch([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.list_(pa.int64())), pa.array(at.astype(np.int32)), none, none, lists(moved[at])], NAMES)


def first_centroids(own: DataFrame, k: int, dim: int, scale: int, seed: int) -> np.ndarray:
    """The k vectors of smallest hashes: k rows."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = own.where((F.size("v") == dim) & finite).orderBy(digest, "v").limit(k).select("v").collect()
    return whole_vectors(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), dim, scale)[1]


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector after ``rounds`` moves of the centroids.

    distance is squared; the inertias sum it over the cluster and over all; the digest is of the
    final centroid's components in decimal, joined by commas."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    centroids = first_centroids(own, k, dim, scale, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    scratch = Scratch(spark, "hamerly")
    rows = scratch.keep(own.mapInArrow(first_state(centroids, dim, scale), STATE), "round0")
    sums = np.zeros((len(centroids), dim + 1), np.int64)
    step = Step(centroids, centroids)
    for i in range(rounds):
        for c, change in sums_of(rows, dim + 1).items():
            sums[c] += change
        moved = np.where(sums[:, -1:] > 0, sums[:, :-1] // np.maximum(sums[:, -1:], 1), centroids)
        step, centroids = Step(centroids, moved), moved
        if i < rounds - 1:
            rows = scratch.keep(rows.where("moved is null").mapInArrow(next_state(step, dim), STATE), f"round{i + 1}")
            scratch.drop(f"round{i}")
    rows = scratch.keep(rows.where("moved is null").mapInArrow(last_state(step, dim), FINAL), "last")
    scratch.drop(f"round{max(0, rounds - 1)}")
    inertia = {c: int(x[0]) for c, x in sums_of(rows, 1).items()}
    facts = [(c, x, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, x in inertia.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.where("moved is null").join(F.broadcast(known), "cluster")  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
