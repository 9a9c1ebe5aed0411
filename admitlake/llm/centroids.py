"""Centroid clustering of whole-number vectors by exponion search, exact in all ties.

Each vector carries an upper bound of the distance to its centroid and a lower bound of that to all
others. Where the bounds do not settle it, only centroids in a ball around its own one are measured:
the sorted list of distances from that centroid says which. The radius, twice the upper bound and the
distance to the centroid's nearest neighbour, holds the two nearest centroids, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Largest component, so that squared distances are exact longs at SIZES components; rounding of bounds, always to the safe side.
LARGEST, SIZES, SAFE = 1 << 27, 64, 1e-12
#: Components up to which products are exact as doubles.
_AS_DOUBLE = 1 << 22


def whole_vectors(vectors: DataFrame, size: int, scale: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, v): vectors of exactly `size` components, none null or not finite, each as floor(scale * x); others go.

    A component beyond LARGEST after scaling is an error, as squared distances would not be longs.
    """
    fine = (F.size(column) == size) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = lambda x: F.floor(x.cast("double") * scale)
    large = lambda x: F.abs(x.cast("double") * scale) > LARGEST
    said = F.raise_error(F.lit(f"a component is larger than {LARGEST} after scaling")).cast("int")
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(key), F.transform(column, lambda x: F.when(large(x), said).otherwise(scaled(x).cast("int"))).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int, key: str = "vec_id") -> np.ndarray:
    """The k vectors of smallest hash of seed and id, in its order; fewer if there are fewer. A null id counts as empty; equal ids go by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    found = vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


class Ball:
    """Centroids, and from each of them the others by distance."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = _squared(centroids, centroids)
        self.lists = np.argsort(apart, axis=1, kind="stable")
        away = np.sqrt(np.take_along_axis(apart, self.lists, 1).astype(np.float64))
        self.away = away * (1 - SAFE)
        alone = np.full(len(away), np.inf)
        self.nearest_low = self.away[:, 1] if len(away) > 1 else alone
        self.nearest_high = away[:, 1] * (1 + SAFE) if len(away) > 1 else alone

    def search(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, lower bound of the second distance) of vectors whose distance to their own centroid is at most `upper`."""
        cluster, best, second = own.copy(), np.zeros(len(v), np.int64), np.full(len(v), np.inf)
        radius = (2 * upper + self.nearest_high[own]) * (1 + SAFE)
        for c in np.unique(own):
            rows = np.flatnonzero(own == c)
            within = np.searchsorted(self.away[c], radius[rows], side="right")
            reach = 1
            while len(rows):
                reach = min(2 * reach, len(self.centroids))
                now = (within <= reach) if reach < len(self.centroids) else np.ones(len(rows), bool)
                if now.any():
                    at, near = rows[now], self.lists[c, :reach]
                    far = _squared(v[at], self.centroids[near])
                    least = far.min(axis=1)
                    chosen = np.where(far == least[:, None], near, len(self.centroids)).min(axis=1)
                    cluster[at], best[at] = chosen, least
                    if reach > 1:
                        others = np.where(near == chosen[:, None], np.iinfo(np.int64).max, far).min(axis=1)
                        second[at] = np.sqrt(others.astype(np.float64)) * (1 - SAFE)
                rows, within = rows[~now], within[~now]
        return cluster, best, second


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, exact."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= _AS_DOUBLE and a.shape[1] <= SIZES:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


def _assigned(rows: DataFrame, key: str, ball: Ball, moved: np.ndarray | None, exact: bool) -> DataFrame:
    """rows (key, v and, after the first time, cluster, upper, lower) with cluster, bounds and, if exact, distance anew.

    moved: how far each centroid went since the bounds were taken; None the first time.
    """
    kind = rows.schema[key].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((ball, moved))
    size = ball.centroids.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball, moved = shared.value
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, size).astype(np.int64)
            cluster, upper, lower, distance = np.zeros(len(v), np.int64), np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v), np.int64)
            if moved is None:
                todo, upper = np.arange(len(v)), np.full(len(v), np.inf)
            else:
                cluster, upper, lower = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(), batch.column(4).to_numpy()
                others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(len(moved))])
                upper = (upper + moved[cluster]) * (1 + SAFE)
                lower = lower - others[cluster]
                lower -= np.abs(np.where(np.isfinite(lower), lower, 0)) * SAFE
                floor = np.maximum(lower, ball.nearest_low[cluster] / 2)
                near = np.flatnonzero(~(upper < floor) | exact)
                distance[near] = ((v[near] - ball.centroids[cluster[near]]) ** 2).sum(1)
                upper[near] = np.sqrt(distance[near].astype(np.float64)) * (1 + SAFE)
                todo = np.flatnonzero(~(upper < floor))
            if len(todo):
                cluster[todo], distance[todo], lower[todo] = ball.search(v[todo], cluster[todo], upper[todo])
                upper[todo] = np.sqrt(distance[todo].astype(np.float64)) * (1 + SAFE)
            out = [batch.column(0), batch.column(1), pa.array(cluster, pa.int32())]
            yield pa.RecordBatch.from_arrays([*out, pa.array(distance)], ["k", "v", "cluster", "distance"]) if exact else pa.RecordBatch.from_arrays([*out, pa.array(upper), pa.array(lower)], ["k", "v", "cluster", "upper", "lower"])

    last = "distance long" if exact else "upper double, lower double"
    return stored(rows.mapInArrow(task, f"k {kind}, v array<int>, cluster int, {last}").withColumnRenamed("k", key))


def _sums(rows: DataFrame, size: int) -> dict[int, tuple[int, np.ndarray]]:
    """How many vectors each cluster has and their sum; one row for each cluster and component comes to the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            v, cluster = batch.column(0).flatten().to_numpy().reshape(-1, size).astype(np.int64), batch.column(1).to_numpy()
            for c in np.unique(cluster).tolist():
                mine = v[cluster == c]
                held[c] = held.get(c, 0) + np.append(mine.sum(0), len(mine))
        for c, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()), pa.array(sums)], ["cluster", "at", "total"])

    parts = rows.select("v", "cluster").mapInArrow(task, "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum("total").alias("total"))
    found: dict[int, np.ndarray] = {}
    for r in parts.collect():
        found.setdefault(r["cluster"], np.zeros(size + 1, np.int64))[r["at"]] = r["total"]
    return {c: (int(s[-1]), s[:-1]) for c, s in found.items()}


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid) of all vectors kept by whole_vectors, one row for each row.

    Centroids start as first_centroids; each round gives every vector to the nearest centroid (squared
    distance; of equals the smaller number) and takes the floor of each cluster's mean; empty clusters
    keep their centroid. Then vectors are given out once more: distance is squared, cluster_inertia and
    inertia are its sums, centroid the components. Rows and state are written in the shared folder after
    each round; k * size numbers come to the driver and go to the tasks. Null vectors and no rows give no
    rows; columns besides the two are passed over.
    """
    if not 0 < size <= SIZES:
        raise ValueError(f"vectors have 1 to {SIZES} components")
    rows = stored(whole_vectors(vectors, size, scale, key, column))
    centroids = first_centroids(rows, k, seed, key)
    schema = "cluster int, cluster_inertia long, inertia long, centroid array<long>"
    if not len(centroids):
        none = rows.sparkSession.createDataFrame([], schema)
        return rows.select(key, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).join(none, "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid")
    moved = None
    for _ in range(rounds):
        rows = _assigned(rows, key, Ball(centroids), moved, exact=False)
        updated = centroids.copy()
        for c, (n, total) in _sums(rows, size).items():
            updated[c] = total // n
        moved = np.sqrt(((updated - centroids) ** 2).sum(1).astype(np.float64)) * (1 + SAFE)
        centroids = updated
    rows = _assigned(rows, key, Ball(centroids), moved, exact=True)
    sums = dict(map(tuple, rows.groupBy("cluster").agg(F.sum("distance")).collect()))
    about = rows.sparkSession.createDataFrame([(c, s, sum(sums.values()), centroids[c].tolist()) for c, s in sorted(sums.items())], schema)
    return rows.join(F.broadcast(about), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid")
