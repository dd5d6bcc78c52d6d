"""Clusters of vectors around centroids, found by annulus search on exact integers.

Centroids are sorted by norm. Any centroid's distance bounds that of a vector's nearest one from above, and
by the triangle inequality the nearest one's norm differs from the vector's by no more than that bound. Two
binary searches give the run of centroids in this annulus, and only they are compared, in 64-bit integers.

Vectors stay where they are: a round sends the k centroids to the tasks and gets k sums from each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut, scratch, tune

#: Vectors of one Arrow batch.
ROWS = 4096
#: Components beyond this size would give distances that are no 64-bit integers.
LARGEST = 1 << 27


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 1024) -> DataFrame:
    """k and v, the components times `scale` rounded down, of vectors with exactly so many finite components.

    Others are left out: null vectors, other lengths, null, infinite or undefined components, and components of
    2^27 or more after scaling, whose distances don't fit a long. Null keys and repeated rows stay.
    """
    x = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double") * scale)
    own = vectors.select(F.col(f"`{key}`").cast("long").alias("k"), x.alias("x")).where(F.size("x") == dims)
    sound = F.forall("x", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return own.where(sound).select("k", F.transform("x", lambda c: F.floor(c).cast("int")).alias("v"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid, of equally near ones the smallest, and the squared distance."""
    lengths = np.sqrt((centroids * centroids).sum(1).astype(np.float64))
    order = np.argsort(lengths, kind="stable")
    lengths = lengths[order]
    own = np.sqrt((x * x).sum(1).astype(np.float64))
    right = np.clip(np.searchsorted(lengths, own), 0, len(order) - 1)
    left = np.maximum(right - 1, 0)
    first = order[np.where(own - lengths[left] <= lengths[right] - own, left, right)]
    squared = lambda rows, which: ((x[rows] - centroids[which]) ** 2).sum(1)
    best, distance = first.copy(), squared(slice(None), first)
    bound = np.sqrt(distance.astype(np.float64))
    slack = 1e-9 * (1 + own + bound)  # far above the error of the square roots, so none at the border is lost
    low, high = np.searchsorted(lengths, own - bound - slack, "left"), np.searchsorted(lengths, own + bound + slack, "right")
    for step in range(int((high - low).max(initial=0))):
        rows = np.flatnonzero(low + step < high)
        which = order[low[rows] + step]
        found = squared(rows, which)
        better = (found < distance[rows]) | ((found == distance[rows]) & (which < best[rows]))
        best[rows[better]], distance[rows[better]] = which[better], found[better]
    return best, distance


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Sum and number of the vectors of each centroid, by component: cluster, place, total, n."""
    k, dims = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:
            x = _matrix(b.column("v"), dims)
            label, _ = nearest(x, centroids)
            there, at = np.unique(np.sort(label), return_index=True)
            if len(there):
                totals[there] += np.add.reduceat(x[np.argsort(label, kind="stable")], at, axis=0)
            counts += np.bincount(label, minlength=k)
        there = np.flatnonzero(counts)
        yield batch(schema, cluster=np.repeat(there, dims), place=np.tile(np.arange(dims), len(there)), total=totals[there].ravel(), n=np.repeat(counts[there], dims))

    rows = kept.select("v").mapInArrow(run, "cluster int, place int, total long, n long")
    return rows.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def _moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: componentwise the mean of their vectors, rounded down; without any, as they were."""
    out = centroids.copy()
    for r in _sums(kept, centroids).collect():
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of which the sha256 of seed and key is smallest, in that order; a null key hashes as an empty one."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in kept.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()], dtype=np.int64)


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", *, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """k, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each sound vector after so many rounds.

    With fewer than `k` vectors each is a centroid; without any the result is empty. Repeated vectors may be
    centroids alike, of which the first gets all. `k` centroids must fit the driver and each task.
    """
    spark = vectors.sparkSession
    tune(spark, ROWS)
    with scratch(spark):
        kept = cut(integers(vectors, key, vector, dims, scale), "vectors", keep=True)
        centroids = first_centroids(kept, k, seed)
        if not len(centroids):
            return _empty(spark)
        for _ in range(rounds):
            centroids = _moved(kept, centroids)
        placed = cut(_placed(kept, centroids), "placed", keep=True)
        inertia = {r["cluster"]: int(r["inertia"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    total = sum(inertia.values())
    # One row for each of the k centroids.
    known = spark.createDataFrame([(j, n, total, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select("k", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _placed(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Key, cluster and distance of each vector."""
    schema = pa.schema([("k", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, distance = nearest(_matrix(b.column("v"), centroids.shape[1]), centroids)
            yield batch(schema, k=b.column("k"), cluster=label, distance=distance)

    return kept.mapInArrow(run, "k long, cluster int, distance long")


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "k long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
