"""Centroid clustering by Orchard's search, in whole numbers.

Every centroid has a list of the others, nearest first.  A vector walks the
list of the nearest centroid so far and marks what it has visited; whenever it
finds a nearer one, it jumps to that one's list.  It stops where the next
centroid is strictly beyond twice the current distance: by the triangle
inequality neither that one nor a later one can be nearer, or even as near.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm._spark import checkpointed

DIMENSIONS, SCALE = 64, 1024
CENTROIDS, ROUNDS, SEED = 8, 10, 3
#: Whole components are held to this size, so that four times a squared distance fits a long.
LARGEST = 1 << 26


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each whole-number vector: the nearest centroid (ties: the smaller number) and the squared distance."""
    n, k = len(vectors), len(centroids)
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    lists = np.array([[j for j in np.lexsort((np.arange(k), row)) if j != i] for i, row in enumerate(between)], np.int64).reshape(k, k - 1)
    best = np.zeros(n, np.int64)
    distance = ((vectors - centroids[0]) ** 2).sum(axis=1) if k else np.zeros(n, np.int64)
    visited = np.zeros((n, max(k, 1)), bool)
    visited[:, 0] = True
    at = np.zeros(n, np.int64)
    live = np.arange(n if k > 1 else 0)
    while len(live):
        other = lists[best[live], at[live]]
        within = between[best[live], other] <= 4 * distance[live]
        live, other = live[within], other[within]
        at[live] += 1
        fresh = ~visited[live, other]
        who, c = live[fresh], other[fresh]
        visited[who, c] = True
        found = ((vectors[who] - centroids[c]) ** 2).sum(axis=1)
        jump = (found < distance[who]) | ((found == distance[who]) & (c < best[who]))
        who, c, found = who[jump], c[jump], found[jump]
        best[who], distance[who], at[who] = c, found, 0
        live = live[at[live] < k - 1]
    return best, distance


def _whole(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _sums(centroids: np.ndarray):
    """One row per task and cluster: how many vectors, their distances and components summed."""

    def run(batches):
        k, dimensions = centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions + 1), np.int64)
        for batch in batches:
            vectors = _whole(batch.column(0), dimensions)
            cluster, distance = nearest(vectors, centroids)
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, np.column_stack([distance, vectors]))
        some = np.flatnonzero(count)
        columns = [some, count[some], *total[some].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cluster", "n", *(f"s{i}" for i in range(dimensions + 1))])

    return run


def _assign(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            cluster, distance = nearest(_whole(batch.column(1), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def _totals(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Rows of cluster, count, summed distance and summed components; at most one per centroid."""
    sums = [f"s{i}" for i in range(centroids.shape[1] + 1)]
    parts = whole.select("v").mapInArrow(_sums(centroids), "cluster long, n long, " + ", ".join(f"{c} long" for c in sums))
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums)).collect()
    return np.array([tuple(r) for r in rows], np.int64).reshape(-1, len(sums) + 2)


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: the vectors of that many finite components, each times scale and floored."""
    held = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("e", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # a NaN is greater
    floored = F.transform("e", lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return embeddings.select("vec_id", held.alias("e")).where(F.size("e") == dimensions).where(finite).select("vec_id", floored.alias("v"))


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each kept vector, and the final centroids.

    Takes ``vec_id, embedding``; other columns are ignored.  Vectors of another
    length, or with a null, NaN or infinite component, are left out.  The first
    centroids are the kept vectors with the smallest sha256 of ``seed:vec_id``;
    rows that repeat an id are vectors of their own (ties by components), and
    null ids come last.  With fewer than k vectors each starts a centroid; with
    none there are no rows.  Whole components beyond LARGEST, whose distances a
    long can't hold, count as LARGEST.

    Every round reads the checkpointed vectors once.  Each task sums its
    vectors by cluster, so that k rows a task are shuffled and k reach the
    driver, however large a cluster is.
    """
    spark = embeddings.sparkSession
    whole = checkpointed(whole_vectors(embeddings, dimensions, scale))
    hashed = whole.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    first = hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {whole.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), np.empty((0, dimensions), np.int64)
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        now = centroids.copy()
        for row in _totals(whole, centroids):
            now[row[0]] = row[3:] // row[1]
        settled = np.array_equal(now, centroids)
        centroids = now
        if settled:  # all further rounds are alike
            break
    inertia = {int(row[0]): int(row[2]) for row in _totals(whole, centroids)}
    about = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    known = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    kind = whole.schema["vec_id"].dataType.simpleString()
    found = whole.mapInArrow(_assign(centroids), f"vec_id {kind}, cluster int, distance long")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
