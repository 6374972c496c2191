"""Clustering around centroids, in exact integers, by annulus search.

The centroids are sorted by their norms.  A vector has an upper bound on the
distance to its nearest centroid: the distance to the one it had in the round
before, or at first to the one whose norm is next to its own.  By the triangle
inequality a centroid that is as near has a norm within that bound of the
vector's.  Two binary searches give these centroids, both ends of the annulus
included, and only they are compared, in integers; of equally near ones the
smaller number wins.  Rounds are map-only: a task adds up its vectors by
centroid, and Spark adds up the tasks' sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import discard, map_batches, materialize

#: Vectors and candidates that are compared at a time; bounds a task's memory.
PAIRS = 16_384
#: Relative widening of the annulus, far above the rounding of norms and square roots.
SLACK = 1e-9
#: The largest component whose squared distances surely fit a long in 64 dimensions; larger ones are counted in Python integers.
FAST = 1 << 27


def integers(vector: Column, scale: int, dimensions: int) -> Column:
    """The vector's components as decimal integers, floor(scale * x); null unless it has ``dimensions`` finite ones."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = (F.size(vector) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(scale * v)))


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(v.astype(float)).sum(-1))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


def nearest(v: np.ndarray, known: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid of each vector, and how many pairs were compared.

    ``known`` is any centroid's number for each vector, or -1.
    """
    if max((int(np.abs(x).max(initial=0)) for x in (v, centroids))) > FAST:
        v, centroids = v.astype(object), centroids.astype(object)
    length, size = norms(centroids), norms(v)
    order = np.argsort(length, kind="stable")
    ring = length[order]
    beside = np.clip(np.searchsorted(ring, size), 0, len(ring) - 1)
    known = np.where(known >= 0, known, order[beside])
    bound = np.sqrt(squared(v, centroids[known]).astype(float))
    slack = SLACK * (bound + size + 1)
    low = np.searchsorted(ring, size - bound - slack, "left")
    high = np.searchsorted(ring, size + bound + slack, "right")
    n = high - low
    edges = np.concatenate([[0], np.cumsum(n)])
    best, distance = np.empty(len(v), np.int64), np.empty(len(v), v.dtype)
    a = 0
    while a < len(v):
        z = max(a + 1, int(np.searchsorted(edges, edges[a] + PAIRS, "right")) - 1)
        of = np.repeat(np.arange(a, z), n[a:z])
        number = order[np.arange(edges[a], edges[z]) - edges[of] + low[of]]
        d = squared(v[of], centroids[number])
        start = edges[a:z] - edges[a]
        least = np.minimum.reduceat(d, start)
        distance[a:z] = least
        best[a:z] = np.minimum.reduceat(np.where(d == np.repeat(least, n[a:z]), number, len(centroids)), start)
        a = z
    return best, distance, int(edges[-1])


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch's lists of longs as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def assign(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``rows(id, v, cluster)`` with their nearest centroids and the ``distance``, squared."""
    at = np.array(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found, distance, _ = nearest(_matrix(b.column("v")), b.column("cluster").to_numpy(), at)
                yield pa.record_batch([b.column("id"), b.column("v"), pa.array(found.astype(np.int32)), pa.array(distance.tolist(), pa.int64())], ["id", "v", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows.select("id", "v", "cluster"), run, f"id {kind}, v array<bigint>, cluster int, distance bigint")


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floors of the means of ``rows(v, cluster)``; a centroid without vectors stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v, cluster = _matrix(b.column("v")), b.column("cluster").to_numpy()
            if int(np.abs(v).max(initial=0)) > FAST:
                v = v.astype(object)
            for c in np.unique(cluster).tolist():
                mine = v[cluster == c]
                n, sums = total.get(c, (0, 0))
                total[c] = [n + len(mine), sums + mine.sum(0).astype(object)]
        rows = [(c, n, i, Decimal(int(x))) for c, (n, sums) in total.items() for i, x in enumerate(sums)]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.decimal128(38, 0)]
        yield pa.record_batch([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * 4, kinds)], ["cluster", "n", "i", "total"])

    sums = map_batches(rows.select("v", "cluster"), run, "cluster int, n bigint, i int, total decimal(38,0)")
    out = [list(c) for c in centroids]
    for r in sums.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # centroids times dimensions
        out[r.cluster][r.i] = int(r.total) // r.n
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """``id_col, cluster, distance`` of every vector of ``dimensions`` finite components, and the final centroids.

    Other rows are left out.  Components are floor(scale * x).  The first
    centroids are the ``k`` vectors whose ``seed:id`` has the least sha256
    (null ids after all others; rows that share an id by their components); of
    fewer vectors each is one, and an empty table has none.  Repeated rows
    count as often as they occur; other columns are ignored.  A component that
    no long holds, or a squared distance, is an error.  The centroids (``k`` of
    them) pass through the driver; a round's table is dropped once the next
    is written.
    """
    v = integers(F.col(vector_col), scale, dimensions)
    rows = materialize(vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.lit(-1).alias("cluster")).filter("v is not null"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "v").select("v").limit(k)
    centroids = [list(r.v) for r in first.collect()]
    for turn in range(rounds + 1 if centroids else 0):
        last, rows = rows, materialize(assign(rows, centroids))
        discard(last)
        if turn < rounds:
            centroids = moved(rows, centroids)
    if not centroids:
        rows = rows.withColumn("distance", F.lit(None).cast("bigint"))
    return rows.select(F.col("id").alias(id_col), "cluster", "distance"), centroids


def digests(clustered: DataFrame, centroids: list[list[int]], id_col: str = "vec_id") -> DataFrame:
    """The columns of ``op11_centroids``: with a cluster's and all clusters' inertia, and digests of the centroids."""
    inertia = clustered.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = clustered.agg(F.sum("distance").alias("inertia"))
    spark = clustered.sparkSession
    written = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids)], "cluster int, written string")
    about = inertia.join(F.broadcast(written), "cluster").join(F.broadcast(whole)).withColumn("centroid_sha256", F.sha2("written", 256)).drop("written")
    return clustered.join(F.broadcast(about), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
