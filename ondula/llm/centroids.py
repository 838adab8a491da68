"""Centroid clustering in exact integers, with Ptolemy's inequality over pivots in front of the exact distances.

For a vector x, a centroid c and pivots p and q the Euclidean distances obey d(x,c) * d(p,q) >= |d(x,p) * d(c,q) - d(x,q) * d(c,p)|. Distances to
pivots are computed once per vector and kept in the written table; distances of centroids to pivots once per round. The bound of a pair is a
few operations whatever the number of components. It is rounded down, and a centroid is passed over only where its bound exceeds the exact
distance of a centroid already seen; all others are compared exactly. So the result is that of the plain method.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import written

#: Vectors, the first by a hash, on which the driver rehearses the rounds to place the pivots.
SAMPLE_ROWS = 1024
PIVOTS = 16
#: Largest absolute value of an integer component: squares of differences fit a long in up to 128 components.
MOST = 1 << 27
#: Relative allowance for rounding; a bound has an error of a few units of 2^-53.
SLACK = 2.0**-44
#: Vectors that one step takes.
STEP = 4096


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the int64 rows of ``x`` to those of ``c``, both n x m, row by row or by broadcasting."""
    d = x - c
    return np.einsum("...i,...i->...", d, d)


def pairwise(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.stack([distances(x, row) for row in c], 1) if len(c) else np.empty((len(x), 0), np.int64)


class Bounds:
    """Centroids of one round and what their bounds need: for each centroid the fixed pairs of its nearest pivot with every other."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        to_pivots = np.sqrt(pairwise(centroids, pivots).astype(float)) if len(pivots) else np.empty((len(centroids), 0))
        between = np.sqrt(pairwise(pivots, pivots).astype(float)) if len(pivots) else np.empty((0, 0))
        self.pairs = []
        for near in to_pivots:
            p = int(near.argmin()) if len(near) else 0
            q = np.flatnonzero(between[p] > 0) if len(near) else np.empty(0, np.int64)
            self.pairs.append((p, q, near[q] / between[p][q] if len(q) else np.empty(0), near[p] / between[p][q] if len(q) else np.empty(0)))

    def lower(self, d: np.ndarray) -> np.ndarray:
        """Bounds of the distances to all centroids, from the distances ``d`` to the pivots."""
        out = np.zeros((len(d), len(self.centroids)))
        for j, (p, q, a, b) in enumerate(self.pairs):
            if len(q):
                left, right = d[:, p, None] * a, d[:, q] * b
                out[:, j] = (np.abs(left - right) - SLACK * (left + right)).max(1)
        return np.maximum(out, 0)


def nearest(x: np.ndarray, d: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, the smaller one of equals; squared distance; exact comparisons made) for each row of ``x``."""
    lower = bounds.lower(d)
    cluster = lower.argmin(1)
    best = distances(x, bounds.centroids[cluster])
    made = len(x)
    first = cluster.copy()
    for j, c in enumerate(bounds.centroids):
        rows = np.flatnonzero((lower[:, j] <= np.sqrt(best) * (1 + SLACK)) & (first != j))
        exact = distances(x[rows], c)
        better = (exact < best[rows]) | (exact == best[rows]) & (j < cluster[rows])
        best[rows[better]] = exact[better]
        cluster[rows[better]] = j
        made += len(rows)
    return cluster, best, made


def moved(centroids: np.ndarray, counts: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Every centroid that has vectors at the floor of their mean; ``counts`` has (number, sums) by centroid."""
    out = centroids.copy()
    for j, (n, sums) in counts.items():
        out[j] = [int(s) // int(n) for s in sums]
    return out


def placed(sample: np.ndarray, start: np.ndarray, rounds: int) -> np.ndarray:
    """Pivots: where a rehearsal on the sample ends and where the centroids start, each once; of more than ``PIVOTS`` those far from the others."""
    c = start.copy()
    for _ in range(rounds if len(sample) else 0):
        own = pairwise(sample, c).argmin(1)
        c = moved(c, {int(j): (int((own == j).sum()), sample[own == j].sum(0).tolist()) for j in np.unique(own)})
    points = np.unique(np.concatenate([c, start]), axis=0)
    chosen = [0]
    far = pairwise(points, points[:1])[:, 0] if len(points) else np.empty(0, np.int64)
    while len(chosen) < min(PIVOTS, len(points)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points, points[chosen[-1]]))
    return points[chosen] if len(points) else points


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=kind).reshape(len(column), -1)


def _parts(batches):
    for whole in batches:
        for k in range(0, whole.num_rows, STEP):
            yield whole.slice(k, STEP)


def _with_pivots(pivots: np.ndarray):
    def run(batches):
        for batch in _parts(batches):
            d = np.sqrt(pairwise(_matrix(batch.column(1), np.int64), pivots).astype(float))
            offsets = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(d.reshape(-1)))], names=["key", "x", "d"])

    return run


def _assigned(model):
    def run(batches):
        bounds = model.value
        for batch in _parts(batches):
            cluster, best, _ = nearest(_matrix(batch.column(1), np.int64), _matrix(batch.column(2), float), bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(best)], names=["key", "cluster", "distance"])

    return run


def _summed(model):
    """For a task: the number of vectors and the sums of their components for each centroid that has any."""
    def run(batches):
        bounds = model.value
        n, sums = np.zeros(len(bounds.centroids), np.int64), np.zeros(bounds.centroids.shape, np.int64)
        for batch in _parts(batches):
            x = _matrix(batch.column(0), np.int64)
            cluster, _, _ = nearest(x, _matrix(batch.column(1), float), bounds)
            n += np.bincount(cluster, minlength=len(n))
            np.add.at(sums, cluster, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "sums"])

    return run


def _kept(e: Column, size: int, scale: int) -> Column:
    inside = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * scale < MOST))
    return F.coalesce((F.size(e) == size) & inside, F.lit(False))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3", key: str = "vec_id",
            embedding: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((key, cluster, distance) of every kept vector, final centroids): Lloyd's rounds over floor(``scale`` * component).

    Kept are vectors of ``size`` components, none of them null, not finite or, scaled, ``MOST`` or more in absolute value (squares would leave
    a long). Centroids start as the ``k`` kept rows with the smallest SHA-256 of ``seed:key`` (rows of equal keys by their components, rows without a key
    last; with fewer rows there are fewer centroids). Each round assigns every vector to the nearest centroid, equals to the smaller number,
    then moves centroids to the exact floor of the mean; empty ones stay. Rows may repeat. An empty table gives an empty result without centroids; other
    columns are not read. What reaches the driver are ``SAMPLE_ROWS`` vectors and, per round, the sums of ``k`` centroids.
    """
    if size * (2 * MOST) ** 2 > 2**63:
        raise ValueError(f"{size} components: squared distances would leave a long")
    spark = vectors.sparkSession
    e = F.col(embedding)
    ints = F.transform(e, lambda v: F.floor(v.cast("double") * scale).cast("int"))
    kept = vectors.where(_kept(e, size, scale)).select(F.col(key).alias("key"), ints.alias("x"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    head = kept.orderBy(order.asc_nulls_last(), "x").limit(max(k, SAMPLE_ROWS)).collect()
    sample = np.array([r["x"] for r in head], np.int64).reshape(-1, size)
    centroids = sample[:k].copy()
    if not len(centroids):
        return kept.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    pivots = placed(sample, centroids, rounds)
    key_type = kept.schema["key"].dataType.simpleString()
    cached = written(kept.mapInArrow(_with_pivots(pivots), f"key {key_type}, x array<int>, d array<double>"))
    totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(Bounds(centroids, pivots))
        partial = cached.select("x", "d").mapInArrow(_summed(model), "cluster int, n long, sums array<long>")
        rows = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect()
        centroids = moved(centroids, {r["cluster"]: (r["n"], [r[f"s{i}"] for i in range(size)]) for r in rows})
    model = spark.sparkContext.broadcast(Bounds(centroids, pivots))
    assigned = written(cached.mapInArrow(_assigned(model), f"key {key_type}, cluster int, distance long"))
    return assigned.withColumnRenamed("key", key), centroids.tolist()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with ``cluster_inertia`` and ``inertia`` (distances summed over the cluster and over all) and ``centroid_sha256``."""
    spark = assigned.sparkSession
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(j, int(s), int(sum(sums.values())), digests[j]) for j, s in sorted(sums.items())]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster")
