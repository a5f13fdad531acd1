"""Clustering of integer vectors around centroids: Lloyd's rounds whose every assignment is exact.

A task takes its vectors in blocks. One float32 matrix product with the centroids gives, for each vector x and centroid
c, an approximate |c|^2 - 2 x.c, which orders centroids as the distance does; a bound on the rounding error that holds for any order of
summation makes an interval of it. The centroids whose interval reaches below the least upper end are the shortlist. Where
it holds one centroid that is the nearest; the others of the shortlist are compared by their distances in 64-bit integers, ties to the lower number.

A round sends k rows of sums for each block of a task, added up before they are shuffled, and k centroids to the driver: both are
bounded by the parameters. Vectors are read anew each round, never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integers import finite, matrix, scaled
from .scratch import Scratch

#: Approximate values that a task holds at once, and pairs that it compares exactly at once.
VALUES, PAIRS = 1 << 22, 1 << 15
_U32, _U64 = 2.0**-24, 2.0**-53


class Nearest:
    """Exact nearest centroids (k x d integers) by float32 screening. ``compared``: vector and centroid pairs that needed integers so far."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.exact = centroids.astype(np.int64)
        self.single = np.ascontiguousarray(centroids.T.astype(np.float32))
        self.norms = (self.exact**2).sum(1).astype(np.float64)
        # Two roundings of inputs and n of products and sums: |error of x.c| <= g |x||c| with g = (n+2)u / (1 - (n+2)u) for any order.
        n = (centroids.shape[1] + 2) * _U32
        self.g = n / (1 - n) * (1 + 1e-6)
        self.compared = 0

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row of integers."""
        cluster = np.empty(len(vectors), np.int64)
        step = max(1, VALUES // len(self.exact))
        for a in range(0, len(vectors), step):
            cluster[a : a + step] = self._block(vectors[a : a + step])
        apart = vectors - self.exact[cluster]
        return cluster, (apart * apart).sum(1)

    def _block(self, x: np.ndarray) -> np.ndarray:
        product = (x.astype(np.float32) @ self.single).astype(np.float64)
        near = self.norms - 2 * product
        length = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        reach = np.sqrt(self.norms) * (1 + 1e-9)
        # The float32 product's error, then those of the norm and of two operations in double precision.
        error = 2 * self.g * length[:, None] * reach + 4 * _U64 * (self.norms + 2 * np.abs(product) + np.abs(near))
        upper = (near + error).min(1)
        listed = near - error <= upper[:, None]
        best = near.argmin(1)
        open_rows = np.flatnonzero(listed.sum(1) > 1)
        if len(open_rows):
            row, number = np.nonzero(listed[open_rows])
            self.compared += len(row)
            distance = np.empty(len(row), np.int64)
            for a in range(0, len(row), PAIRS):
                apart = x[open_rows[row[a : a + PAIRS]]] - self.exact[number[a : a + PAIRS]]
                distance[a : a + PAIRS] = (apart * apart).sum(1)
            order = np.lexsort((number, distance, row))
            first = order[np.searchsorted(row[order], np.arange(len(open_rows)))]
            best[open_rows] = number[first]
        return best


def _sums(centroids: np.ndarray):
    """Task of a round: (cluster, dimension, sum, count) of its vectors; one set of rows for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, (k, d) = Nearest(centroids), centroids.shape
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column("ints"), d)
            cluster, _ = nearest(x)
            order = np.argsort(cluster, kind="stable")
            met, first = np.unique(cluster[order], return_index=True)
            if len(met):
                sums[met] += np.add.reduceat(x[order], first, axis=0)
                counts += np.bincount(cluster, minlength=k)
        met = np.flatnonzero(counts)
        if len(met):
            columns = [np.repeat(met, d), np.tile(np.arange(d), len(met)), sums[met].reshape(-1), np.repeat(counts[met], d)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "dimension", "total", "n"])

    return run


def _assigned(centroids: np.ndarray):
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids)
        for batch in batches:
            cluster, distance = nearest(matrix(batch.column("ints"), centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(digests).take(pa.array(cluster))], names=["row", "cluster", "distance", "centroid_sha256"])

    return run


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The integers of the k rows whose sha256 of ``seed:vec_id`` is least, in that order; equal hashes by the integers. Null ids aren't chosen."""
    named = kept.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "ints")
    return np.array([r.ints for r in named.orderBy("h", "ints").limit(k).collect()], dtype=np.int64)


def assign(vectors: DataFrame, *, k: int = 16, width: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1) -> DataFrame:
    """The vectors with exactly ``width`` finite components, all their columns, and cluster, distance and centroid_sha256 after ``rounds`` rounds.

    Components become floor(scale * x). Each round assigns every vector to the nearest centroid and replaces every centroid that has vectors
    by the floor of their exact mean. Columns of vectors that are named like the three new ones are replaced. Vectors left out: see cluster().
    """
    kept = vectors.where(finite("embedding") & (F.size("embedding") == width)).withColumn("ints", scaled("embedding", scale))
    narrow = kept.select("ints")
    centroids = first_centroids(kept.select("vec_id", "ints"), k, seed)
    others = [c for c in vectors.columns if c not in ("cluster", "distance", "centroid_sha256")]
    row = kept.select(F.struct(*others).alias("row"), "ints")
    schema = vectors.select(*others).schema.simpleString()
    if not len(centroids):
        made = row.where("false").select("row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit("").alias("centroid_sha256"))
    else:
        for _ in range(rounds):
            sums = narrow.mapInArrow(_sums(centroids), "cluster long, dimension long, total long, n long")
            exact = sums.groupBy("cluster", "dimension").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
            centroids = centroids.copy()
            for r in exact.collect():  # k * width rows at most
                centroids[r.cluster, r.dimension] = int(r.total) // r.n
        made = row.mapInArrow(_assigned(centroids), f"row {schema}, cluster int, distance long, centroid_sha256 string")
    return made.select(*(F.col(f"row.`{c}`") for c in others), "cluster", "distance", "centroid_sha256")


def cluster(vectors: DataFrame, *, k: int = 16, width: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia and inertia (distances summed over its cluster and over all) and centroid_sha256.

    Defined cases: vectors that are null, of another size, or hold null, NaN or infinite components have no row; fewer than k vectors start fewer
    centroids, none give an empty table; repeated rows are rows of their own, and may start several equal centroids, of which the first takes all; a null
    vec_id is clustered, but starts no centroid, and where all are null there is no centroid and no row; components too large for exact 64-bit
    distances raise an error; other columns are left aside.
    """
    scratch = Scratch(vectors.sparkSession)
    made = assign(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), k=k, width=width, scale=scale, rounds=rounds, seed=seed)
    made = scratch.write(made.drop("embedding"), "clusters")
    sums = made.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("long").alias("cluster_inertia"))
    total = sums.agg(F.sum(F.col("cluster_inertia").cast("decimal(20,0)")).cast("long").alias("inertia"))
    # k rows and one row: bounded by the parameter.
    out = made.join(F.broadcast(sums), "cluster").join(F.broadcast(total))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
