"""Lloyd's clustering in exact integers, with the adaptive bounds of Drake and Hamerly (2012).

Of each vector the state keeps its cluster, an upper bound of the distance to that centroid, the next nearest
centroids with a lower bound for each, and one bound for all the rest. When centroids move, the bounds move by
as much. Where the upper bound is below all others, the cluster stands; where it is below those from some place on, only
the centroids before that place are measured; where it is below none, all are. Bounds are doubles with a margin that
is wider than their rounding; what is measured are squared distances in integers, so results are exact.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch
from .topk import MOST

SCALE, DIMENSION, CLUSTERS, ROUNDS, SEED = 256, 64, 40, 5, 2
#: Centroids with a bound of their own, beside the nearest.
BOUNDS = 8
#: Components up to this size are worked on as longs, larger ones as integers without bound.
SMALL = 1 << 27
#: Of a bound; the rounding of its sums is 1e-16 each.
MARGIN = 1e-12
#: Vectors that are measured at once.
PART = 2048
LIMB = 32
#: v: components as four bytes each, or as doubles before scaling where these don't do
STATE = "vec_id long, v binary, cluster int, upper double, near binary, lower binary, rest double, distance long"


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), also where the product isn't a double."""
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


def usable(vectors: DataFrame, dimension: int) -> DataFrame:
    """(vec_id, x array<double>) of vectors with exactly so many components, none null or non-finite."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    real = (F.size("embedding") == dimension) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull()).where(real).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


class Centroids:
    """Centroids as lists of integers; how far each has moved."""

    def __init__(self, rows: list[list[int]], moved: list[float] | None = None):
        self.rows = rows
        self.moved = np.array([0.0] * len(rows) if moved is None else moved)
        small = [all(-SMALL <= x <= SMALL for x in row) for row in rows]
        #: numbers of those whose distances to small vectors don't fit longs
        self.large = [i for i, s in enumerate(small) if not s]
        self.array = np.array([row if s else [0] * len(row) for row, s in zip(rows, small, strict=True)], np.int64).reshape(len(rows), -1)

    def next(self, rows: list[list[int]]) -> Centroids:
        """These rows, with the distances that they lie from the present ones, rounded up."""
        apart = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(self.rows, rows, strict=True)]
        return Centroids(rows, [math.sqrt(d) * (1 + MARGIN) if d < 2**1000 else math.inf for d in apart])

    def to_all(self, v: np.ndarray) -> np.ndarray:
        """Squared distances of small vectors to all centroids: longs, or objects where a centroid is large."""
        most = int(np.abs(v).max(initial=0)) * int(np.abs(self.array).max(initial=0)) * max(1, v.shape[1])
        dots = (v.astype(np.float64) @ self.array.T.astype(np.float64)).astype(np.int64) if most < 2**53 else v @ self.array.T
        out = (v * v).sum(axis=1)[:, None] - 2 * dots + (self.array * self.array).sum(axis=1)
        if self.large:
            out = out.astype(object)
            for c in self.large:
                out[:, c] = ((v.astype(object) - np.array(self.rows[c], object)) ** 2).sum(axis=1)
        return out

    def to_some(self, v: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of small vectors to the centroids named in each one's row; all centroids are small."""
        apart = v[:, None, :] - self.array[which]
        return np.einsum("nkd,nkd->nk", apart, apart)

    def to_large(self, x: list[int]) -> list[int]:
        """Squared distances of a vector of any size."""
        return [sum((a - b) ** 2 for a, b in zip(x, row, strict=True)) for row in self.rows]


class Part:
    """Vectors of a batch with their state, assigned in place."""

    def __init__(self, v: np.ndarray, cluster, upper, near, lower, rest):
        self.v, self.cluster, self.upper, self.near, self.lower, self.rest = v, cluster, upper, near, lower, rest
        self.distance = np.zeros(len(v), np.int64)
        #: vectors measured against some and against all centroids
        self.some, self.all = 0, 0

    def scan(self, at: np.ndarray, centroids: Centroids) -> None:
        """All centroids for these vectors."""
        self.all += len(at)
        b = self.near.shape[1]
        for k in range(0, len(at), PART):
            go = at[k : k + PART]
            d = centroids.to_all(self.v[go])
            order = np.argsort(d, axis=1, kind="stable")  # ties: the smaller number first
            first = np.take_along_axis(d, order[:, : b + 2], axis=1)
            self.distance[go] = np.minimum(first[:, 0], MOST).astype(np.int64)
            root = np.sqrt((np.minimum(first, 2**1000) if first.dtype == object else first).astype(np.float64))
            self.cluster[go], self.upper[go] = order[:, 0], root[:, 0] * (1 + MARGIN)
            self.near[go], self.lower[go] = order[:, 1 : b + 1], root[:, 1 : b + 1] * (1 - MARGIN)
            self.rest[go] = root[:, b + 1] * (1 - MARGIN) if d.shape[1] > b + 1 else np.inf

    def reassign(self, centroids: Centroids) -> None:
        """After a move: as many centroids for each vector as its bounds can't rule out."""
        if centroids.large:
            return self.scan(np.arange(len(self.v)), centroids)
        moved, b = centroids.moved, self.near.shape[1]
        self.upper += moved[self.cluster]
        self.lower -= moved[self.near]
        self.rest -= moved.max(initial=0)
        # the least bound from each place on
        floor = np.concatenate((self.lower, self.rest[:, None]), axis=1)
        floor = np.minimum.accumulate(floor[:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(~(self.upper < floor[:, 0]))
        for k in range(0, len(open_), PART):  # the true distance first; it may do
            go = open_[k : k + PART]
            d = centroids.to_some(self.v[go], self.cluster[go][:, None])[:, 0]
            self.upper[go] = np.sqrt(d.astype(np.float64)) * (1 + MARGIN)
        sure = self.upper[open_][:, None] < floor[open_]
        need = np.where(sure.any(axis=1), sure.argmax(axis=1), b + 1)
        for p in range(1, b + 1):
            at = open_[need == p]
            self.some += len(at)
            for k in range(0, len(at), PART):
                go = at[k : k + PART]
                which = np.sort(np.concatenate((self.cluster[go][:, None], self.near[go, :p]), axis=1), axis=1)  # ties: the smaller number first
                d = centroids.to_some(self.v[go], which)
                order = np.argsort(d, axis=1, kind="stable")
                which, root = np.take_along_axis(which, order, axis=1), np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
                self.cluster[go], self.upper[go] = which[:, 0], root[:, 0] * (1 + MARGIN)
                self.near[go, :p], self.lower[go, :p] = which[:, 1:], root[:, 1:] * (1 - MARGIN)
        self.scan(open_[need == b + 1], centroids)
        return None

    def measure(self, centroids: Centroids) -> None:
        """The distance of each vector to its centroid."""
        if not centroids.large:  # else all were scanned
            for k in range(0, len(self.v), PART):
                go = slice(k, k + PART)
                self.distance[go] = centroids.to_some(self.v[go], self.cluster[go][:, None])[:, 0]


def _first(dimension: int):
    """(vec_id, x) as rows of the state that are in no cluster yet."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dimension)
            small = (np.abs(x) * SCALE <= SMALL - 1).all(axis=1) if dimension else np.ones(batch.num_rows, bool)
            packed = np.floor(np.where(small[:, None], x, 0) * SCALE).astype("<i4")
            raw = [p.tobytes() if s else w.astype("<f8").tobytes() for p, w, s in zip(packed, x, small, strict=True)]
            none = lambda kind: pa.nulls(batch.num_rows, kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), none(pa.int32()), none(pa.float64()), none(pa.binary()), none(pa.binary()), none(pa.float64()), none(pa.int64())], names=[c.split(" ")[0] for c in STATE.split(", ")])

    return run


def _split(column: pa.Array, dimension: int):
    """The components of a state's vectors: places and longs of small ones, places and integers of the others."""
    raw = column.to_pylist()
    small = np.array([len(r) == 4 * dimension for r in raw], bool)
    packed = np.frombuffer(b"".join(r for r, s in zip(raw, small, strict=True) if s), "<i4").reshape(-1, dimension).astype(np.int64)
    others = np.flatnonzero(~small)
    return np.flatnonzero(small), packed, others, [[_whole(x, SCALE) for x in np.frombuffer(raw[i], "<f8").tolist()] for i in others.tolist()]


def _assign(shared, dimension: int, bounds: int):
    def run(batches):
        centroids = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at, v, others, large = _split(batch.column(1), dimension)
            cluster, upper, near, lower, rest = np.zeros(n, np.int32), np.zeros(n), np.zeros((n, bounds), "<u2"), np.zeros((n, bounds)), np.zeros(n)
            distance = np.zeros(n, np.int64)
            if batch.column(2).null_count:
                part = Part(v, cluster[at], upper[at], near[at], lower[at], rest[at])
                part.scan(np.arange(len(at)), centroids)
            else:
                wide = lambda i, kind: np.frombuffer(b"".join(batch.column(i).to_pylist()), kind).reshape(n, bounds)[at]
                part = Part(v, batch.column(2).to_numpy()[at], batch.column(3).to_numpy()[at], wide(4, "<u2"), wide(5, "<f8"), batch.column(6).to_numpy()[at])
                part.reassign(centroids)
            part.measure(centroids)
            cluster[at], upper[at], near[at], lower[at], rest[at], distance[at] = part.cluster, part.upper, part.near, part.lower, part.rest, part.distance
            for i, x in zip(others.tolist(), large, strict=True):  # measured against all, in every round
                d = centroids.to_large(x)
                cluster[i] = min(range(len(d)), key=d.__getitem__)
                distance[i] = min(d[cluster[i]], MOST)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cluster), pa.array(upper), pa.array([r.tobytes() for r in near], pa.binary()), pa.array([r.tobytes() for r in lower], pa.binary()), pa.array(rest), pa.array(distance)],
                names=[c.split(" ")[0] for c in STATE.split(", ")],
            )

    return run


def _sums(dimension: int):
    """Of a task: (cluster, i, limb, part) of the sums of each cluster's components; i = -1 has its vectors."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            at, v, others, large = _split(batch.column(1), dimension)
            cluster = batch.column(0).to_numpy()
            order = np.argsort(cluster[at], kind="stable")
            name, begin, count = np.unique(cluster[at][order], return_index=True, return_counts=True)
            if len(name):
                for c, total, size in zip(name.tolist(), np.add.reduceat(v[order], begin, axis=0), count.tolist(), strict=True):
                    held = sums.setdefault(c, np.zeros(dimension + 1, object))
                    held += np.append(total.astype(object), size)
            for i, x in zip(others.tolist(), large, strict=True):
                sums.setdefault(int(cluster[i]), np.zeros(dimension + 1, object))[:] += np.array([*x, 1], object)
        rows = []
        for c, held in sums.items():
            for i, x in enumerate(held.tolist()):
                limb = 0
                while True:  # two's complement, the last limb signed
                    low = x & (1 << LIMB) - 1
                    if -(1 << LIMB) <= x < 1 << LIMB:
                        rows.append((c, i if i < dimension else -1, limb, x))
                        break
                    rows.append((c, i if i < dimension else -1, limb, low))
                    x, limb = x >> LIMB, limb + 1
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cluster", "i", "limb", "part"])

    return run


def means(state: DataFrame, centroids: Centroids, dimension: int) -> list[list[int]]:
    """floor(sum / count) of each cluster's vectors; an empty cluster's centroid stays.

    Tasks send a sum for each cluster and component; the driver gets these added up: clusters times components.
    """
    parts = state.select("cluster", "v").mapInArrow(_sums(dimension), "cluster int, i int, limb int, part long")
    sums: dict[int, list[int]] = {}
    for c, i, limb, part in parts.groupBy("cluster", "i", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)"))).collect():
        sums.setdefault(c, [0] * (dimension + 1))[i] += int(part) << LIMB * limb
    return [[x // sums[c][-1] for x in sums[c][:-1]] if c in sums else row for c, row in enumerate(centroids.rows)]


def seeds(kept: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of `seed:vec_id`, in that order; copies of an id by their components."""
    ranked = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    return [[_whole(x, SCALE) for x in row.x] for row in ranked.orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).collect()]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION, bounds: int = BOUNDS) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with exactly `dimension` components, none null or non-finite, take part, with components floor(256 * x).
    Each round assigns every vector to the nearest centroid (squared Euclidean distance; ties: the smaller number)
    and replaces each centroid by the floor of its vectors' mean; one that has none stays. A last assignment follows.
    distance is the squared distance to the final centroid, the inertias are its sums, centroid_sha256 is of the
    centroid's components joined by commas; distances and sums beyond a long are given as the largest long.

    Fewer vectors than clusters make that many clusters. Each repeated row is a vector of its own; rows without a
    vec_id take part, and are seeds only after all others. An empty table gives an empty result. Other columns
    don't matter. Centroids (clusters x dimension) are sent to the tasks and pass through the driver; they don't
    grow with the input. Up to 65,536 clusters.
    """
    if not 0 < clusters <= 1 << 16:
        raise ValueError("clusters must be 1 to 65536")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    kept = usable(vectors, dimension)
    now = Centroids(seeds(kept, clusters, seed) or [[0] * dimension])  # without vectors nothing will be assigned
    bounds = min(bounds, len(now.rows) - 1)
    older, state = None, kept.mapInArrow(_first(dimension), STATE)
    for k in range(rounds + 1):
        passing = Scratch(spark)
        state = passing.keep(state.mapInArrow(_assign(spark.sparkContext.broadcast(now), dimension, bounds), STATE))
        if older:
            older.drop()
        older = passing
        if k < rounds:
            now = now.next(means(state, now, dimension))
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in now.rows]
    per = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a row for each cluster
    total = sum(int(r.d) for r in per)
    about = [(r["cluster"], min(int(r.d), MOST), min(total, MOST), digests[r["cluster"]]) for r in per]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster")
    out = scratch.finish(out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
    older.drop()
    return out
