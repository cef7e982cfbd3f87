"""Centroid clustering (Lloyd's rounds, exact integers) with lower bounds from Ptolemy's inequality over fixed pivot pairs.

Vectors are made integers (`vectors.py`). The pivots are the first centroids; each vector is stored once with its distances to them. For a
vector x, a centroid c and a pair of pivots p, s Ptolemy's inequality gives

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s),

so a round needs only the cached distances and the few between centroids and pivots. The centroid of the least bound is measured first, then those whose
bound does not exceed that distance; bounds are lowered by more than rounding can cost before they decide, and all that survive are measured exactly in
integers. A round is one scan of the stored table; tasks send one row of exact sums per cluster, so a hot vector or cluster costs nothing extra. The driver
holds only the centroids and their sums.

Cases: only vectors with `components` components take part, none null or non-finite (or too large, see `vectors.py`); all rows count, repeated ones too.
The first centroids have the smallest hashes of `3:<vec_id>`, null ids last, equal hashes by components; fewer vectors than clusters make fewer clusters.
Ties go to the smaller number. Distances and sums beyond 64 bits are held at its limit. Empty tables give no rows. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import stored
from .vectors import EXACT, LONG, integers, unpack, usable, within_long

#: Vectors that are handled at a time.
CHUNK = 1 << 14
#: Relative error allowed for bounds, far above that of doubles.
SLACK = 1e-9


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x to the one vector c."""
    if 4 * x.shape[1] * max(np.abs(x).max(initial=0), np.abs(c).max(initial=0), 1) ** 2 < EXACT:
        d = x - c
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    d = integers(x) - integers(c)
    return within_long((d * d).sum(axis=1))


def pairs_of(pivots: np.ndarray) -> list[tuple[int, int, float]]:
    """Fixed pairs of neighbouring pivots, each with the distance between them; equal pivots make no pair."""
    n = len(pivots)
    found = [(i, (i + 1) % n) for i in range(n if n > 2 else n - 1)]
    apart = [(i, j, float(np.sqrt(((pivots[i] - pivots[j]) ** 2).sum()))) for i, j in found]
    return [p for p in apart if p[2] > 0]


def bounds(to_pivot: np.ndarray, centroid_to_pivot: np.ndarray, pairs: list[tuple[int, int, float]]) -> np.ndarray:
    """Lower bounds of the distance of each vector (row) to each centroid (column)."""
    out = np.zeros((len(to_pivot), len(centroid_to_pivot)))
    for p, s, apart in pairs:
        one, two = np.outer(to_pivot[:, p], centroid_to_pivot[:, s]), np.outer(to_pivot[:, s], centroid_to_pivot[:, p])
        np.maximum(out, (np.abs(one - two) - SLACK * (one + two)) / apart * (1 - SLACK), out=out)
    return out


def nearest(x: np.ndarray, to_pivot: np.ndarray, centroids: np.ndarray, pivots: np.ndarray, pairs: list) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact distances computed) of each vector."""
    between = np.sqrt(((centroids[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
    least = bounds(to_pivot, between, pairs)
    guess = least.argmin(axis=1)
    best, distance, measured = guess.copy(), np.zeros(len(x), np.int64), len(x)
    for c in range(len(centroids)):
        own = np.flatnonzero(guess == c)
        distance[own] = squared(x[own], centroids[c])
    for c in range(len(centroids)):
        ask = np.flatnonzero((guess != c) & (least[:, c] <= np.sqrt(distance.astype(float)) * (1 + SLACK) + SLACK))
        measured += len(ask)
        found = squared(x[ask], centroids[c])
        nearer = (found < distance[ask]) | ((found == distance[ask]) & (c < best[ask]))
        best[ask[nearer]], distance[ask[nearer]] = c, found[nearer]
    return best, distance, measured


class Clustering:
    """Centroids (doubles that hold integers), the fixed pivots and their pairs."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids, self.pivots, self.pairs = centroids, pivots, pairs_of(pivots)

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(chunk, vectors, cluster, squared distance, exact distances computed)."""
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x = unpack(part.column("c"), part.column("wide").to_numpy(zero_copy_only=False), self.pivots.shape[1])
                to_pivot = part.column("to_pivot").flatten().to_numpy().reshape(len(x), -1)
                yield part, x, *nearest(x, to_pivot, self.centroids, self.pivots, self.pairs)

    def digest(self, cluster: int) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.centroids[cluster]).encode()).hexdigest()


def first_centroids(packed: DataFrame, clusters: int, components: int) -> np.ndarray:
    name = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    found = packed.select("c", "wide", name.alias("name")).orderBy(F.asc_nulls_last("name"), "c").limit(clusters).toArrow()
    return unpack(found["c"], found["wide"].to_numpy(), components)


def with_pivots(packed: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each vector with its distances to the pivots."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x = unpack(part.column("c"), part.column("wide").to_numpy(zero_copy_only=False), pivots.shape[1])
                far = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
                first = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(pivots))
                columns = [part.column(c) for c in ("vec_id", "c", "wide")] + [pa.ListArray.from_arrays(first, pa.array(far.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "c", "wide", "to_pivot"])

    return packed.mapInArrow(read, "vec_id long, c binary, wide boolean, to_pivot array<double>")


def moved(table: DataFrame, model: Clustering) -> np.ndarray:
    """The centroids after one round: the exact floor of each cluster's mean, as they were where a cluster is empty."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, list[int]]] = {}
        for _, x, cluster, _, _ in model.chunks(batches):
            for c in np.unique(cluster):
                own = x[cluster == c]
                exact = np.abs(own).max(initial=0) * len(own) < EXACT
                total = own.sum(axis=0).astype(object) if exact else integers(own).sum(axis=0)
                n, before = sums.get(c, (0, [0] * x.shape[1]))
                sums[c] = n + len(own), [int(a) + b for a, b in zip(total, before)]
        for c, (n, total) in sums.items():
            yield pa.RecordBatch.from_pylist([{"cluster": int(c), "n": n, "at": k, "total": str(v)} for k, v in enumerate(total)], schema=SUMS)

    each = table.mapInArrow(read, "cluster int, n long, at int, total string")
    rows = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out = model.centroids.copy()
    for cluster, at, n, total in rows:  # clusters x components rows
        out[cluster, at] = int(total) // n
    return out


SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("at", pa.int32()), ("total", pa.string())])


def cluster_vectors(vectors: DataFrame, clusters: int = 8, rounds: int = 10, components: int = 64) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    packed = usable(vectors, components)
    pivots = first_centroids(packed, clusters, components)
    if not len(pivots):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    table = stored(with_pivots(packed, pivots), "pivots")
    model = Clustering(pivots, pivots)
    for _ in range(rounds):
        after = moved(table, model)
        if (after == model.centroids).all():  # nothing can move any more
            break
        model = Clustering(after, pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, distance, _ in model.chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = stored(table.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    total = min(sum(sums.values()), LONG.max)
    rows = [(c, min(s, LONG.max), total, model.digest(c)) for c, s in sums.items()]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
