"""Orchard's search and the rounds around it, against all distances."""

from __future__ import annotations

import hashlib
import math

import numpy as np

from fieldspark.llm import centroids

SHAPE = "vec_id long, embedding array<float>, cluster string"


def _plain(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in middle]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(middle)):
            own = [v for (_, v), (c, _) in zip(kept, found, strict=True) if c == j]
            if own:
                middle[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    total = sum(d for _, d in found)
    return [(i, c, d, sum(e for b, e in found if b == c), total, hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for (i, _), (c, d) in zip(kept, found, strict=True)]


def _key(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_nearest_equals_all_distances():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3, 8, 40):
        for span in (1, 3, 1000):  # a small span makes ties and equal centroids
            vectors, middle = rng.integers(-span, span + 1, (500, 6)), rng.integers(-span, span + 1, (k, 6))
            every = ((vectors[:, None] - middle[None]) ** 2).sum(axis=2)
            best, distance = centroids.nearest(vectors, middle)
            assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert len(centroids.nearest(np.empty((0, 6), np.int64), middle)[0]) == 0


def test_clusters_equal_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.select("vec_id", "embedding").collect()]
    assert _key(centroids.cluster(table)[0].collect()) == _key(_plain(rows))


def test_odd_vectors(spark):
    def v(x, *rest):
        return [x, *rest, *[0.0] * (63 - len(rest))]

    rows = [(1, v(0.5)), (1, v(0.5)), (1, v(-0.25)), (2, None), (3, []), (4, [1.0] * 63), (5, v(float("nan"))), (6, v(float("-inf"))), (7, [None] * 64), (None, v(0.75)), (8, v(-0.0001)), (9, [0.0] * 65)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SHAPE)
    assert _key(centroids.cluster(frame)[0].collect()) == _key(_plain(rows))
    assert len(centroids.cluster(frame)[1]) == 5  # fewer than eight are kept
    huge = spark.createDataFrame([(1, v(3e38), "x"), (2, v(-3e38), "x")], SHAPE)
    assert {r["distance"] for r in centroids.cluster(huge)[0].collect()} == {0}
    assert centroids.cluster(frame.where("vec_id = 2"))[0].collect() == []
    assert centroids.cluster(frame.limit(0))[0].columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
