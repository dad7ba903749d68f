"""Centroid clustering against plain k-means on whole numbers, and its bounds against points."""

import hashlib
import math

import numpy as np
import pytest
from samples import with_clashes

from eventide.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_means(vectors, start, rounds):
    """Lloyd's algorithm with Python's integers."""
    centroids = [list(map(int, c)) for c in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for v in vectors]
        for i in range(len(centroids)):
            own = [v for v, k in zip(vectors, of, strict=True) if k == i]
            if own:
                centroids[i] = [sum(axis) // len(own) for axis in zip(*own, strict=True)]
    return [nearest(v) for v in vectors], centroids


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], SCHEMA)


def test_no_point_of_the_sphere_is_neared_by_more_than_the_bound():
    rng = np.random.default_rng(5)
    tighter = 0
    for _ in range(400):
        axes = int(rng.integers(2, 6))
        center, before = rng.normal(size=axes) * 3, rng.normal(size=axes) * 3
        after = before + rng.normal(size=axes) * rng.choice([0.01, 0.5, 3.0])
        radius = abs(rng.normal()) * rng.choice([0.1, 1.0, 3.0])
        bound = clusters.approach(center, radius, before, after)
        ways = rng.normal(size=(400, axes))
        points = center + ways / np.linalg.norm(ways, axis=1)[:, None] * radius * rng.random((400, 1)) ** 0.1
        neared = np.linalg.norm(points - before, axis=1) - np.linalg.norm(points - after, axis=1)
        drift = np.linalg.norm(after - before)
        assert neared.max() <= bound + 1e-9 and 0 <= bound <= drift + 1e-12
        tighter += bound < 0.9 * drift
    assert tighter > 150


def test_a_centroid_that_moves_away_loosens_nothing():
    center = np.zeros(3)
    assert clusters.approach(center, 1.0, np.array([5.0, 0, 0]), np.array([9.0, 0, 0])) == 0
    assert clusters.approach(center, 1.0, np.array([9.0, 0, 0]), np.array([5.0, 0, 0])) == 4
    assert clusters.approach(center, 1.0, center + 2, center + 2) == 0


@pytest.mark.parametrize("spread", [0.5, 6.0])
def test_same_clusters_as_plain_means_and_fewer_scans(spark, spread):
    rng = np.random.default_rng(11)
    middles = rng.integers(-60, 60, size=(9, 4))
    vectors = (middles[rng.integers(0, 9, 900)] + rng.normal(size=(900, 4)) * spread).astype(int)
    # A third of all rows are equal, and some lie halfway between two centroids.
    vectors[:300] = vectors[0]
    start = vectors[299:315]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, vector array<int>")
    scans = []
    assigned, centroids = clusters.cluster_vectors(table.repartition(5), start, 5, scans)
    want, moved = plain_means(vectors.tolist(), start, 5)
    assert centroids.tolist() == moved
    assert [r.cluster for r in assigned.orderBy("vec_id").collect()] == [k for _, k in want]
    assert scans[0] == 900 and sum(scans[1:]) < 0.7 * 900 * len(scans[1:])


def test_digest_of_awkward_rows(spark):
    good = [[math.sin(i * j + i) for j in range(64)] for i in range(45)]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [
        (7, good[7], 1), (None, good[8], 2), (None, good[9], 2),
        (100, None, 0), (101, [], 0), (102, good[0][:63], 0), (103, [*good[0], 1.0], 0),
        (104, [None, *good[0][1:]], 0), (105, [float("nan"), *good[0][1:]], 0),
        (106, [float("-inf"), *good[0][1:]], 0), (107, [3e38, -3e38, *good[0][2:]], 0)]
    table = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = clusters.clustered(table).collect()
    kept = [(r[0], [max(-2**27, min(2**27, math.floor(256.0 * float(np.float32(x))))) for x in r[1]])
            for r in rows if r[0] is None or r[0] < 100 or r[0] == 107]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    found, centroids = plain_means([v for _, v in kept], [v for _, v in order[:40]], 5)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = [sum(d for d, k in found if k == i) for i in range(40)]
    want = [(i, k, d, inertia[k], sum(inertia), digests[k]) for (i, _), (d, k) in zip(kept, found, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_centroids(spark, n):
    rows = clusters.clustered(rows_of(spark, [[i] * 64 for i in range(n)])).collect()
    assert len(rows) == n and {r.distance for r in rows} <= {0} and len({r.cluster for r in rows}) == n
