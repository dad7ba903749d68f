"""Centroid clustering: k-means whose bounds are loosened by geometry, not by full drift.

A vector keeps an upper bound of the distance to its own centroid and a lower bound of that to any
other; as long as the first is less than the second, nothing of it is computed. When centroids move,
the upper bound grows by the drift of its own. How far the lower bound must fall is worked out once a
cluster: all its vectors lie in a sphere around the old centroid, and in the plane of that center and
of another centroid's old and new place, a line past the sphere bounds by how much that one can have
come nearer to any vector inside. Vectors whose bounds do not decide are measured against their own
centroid, then against all.

Components are integers, so distances, sums and floors are exact, whatever the order of rows. What
reaches the driver are sums per cluster and axis; vectors stay in files, one table a round, and the
table of the round before is removed. An executor lost costs its part of one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.store import discard, settle

AXES, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
# Components beyond are cut off here, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 27
# Up to this size all products and their sums are exact as doubles.
_EXACT_AS_DOUBLE = 1 << 22
# Room for the rounding of square roots and of stored single-precision bounds.
_SLACK = 1e-6

_STATE = "cluster int, upper float, lower float, scanned int"


class Motion(NamedTuple):
    """Centroids, and what a step made of the bounds of each cluster's vectors."""

    centroids: np.ndarray
    drift: np.ndarray
    loosening: np.ndarray
    gap: np.ndarray


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of every vector to every centroid."""
    largest = max((int(np.abs(x).max()) for x in (vectors, centroids) if x.size), default=0)
    kind = np.float64 if largest <= _EXACT_AS_DOUBLE else np.int64
    x, c = vectors.astype(kind), centroids.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def approach(center: np.ndarray, radius: float, before: np.ndarray, after: np.ndarray) -> float:
    """An upper bound of how much nearer a point that moves from ``before`` to ``after`` comes to
    any point of a sphere; never more than the way it moved, and 0 where it cannot come nearer.

    Points that it comes nearer to by at least a given amount fill one sheet of a hyperboloid around
    ``after``. By symmetry the plane through the sphere's center and both places decides. There the
    sheet lies above its own vertex, and inside its asymptotes, which meet halfway: a sphere below
    the vertex, or beside a line through the halfway point, is outside of the sheet.
    """
    way = after - before
    drift = float(np.sqrt(way @ way))
    if drift == 0:
        return 0.0
    from_half = center - (before + after) / 2
    along = float(from_half @ way) / drift
    far = float(from_half @ from_half)
    beside = max(far - along * along, 0.0) ** 0.5
    vertex = min(drift, max(0.0, 2 * (along + radius)))
    if far <= radius * radius:
        return vertex
    tangent = (far - radius * radius) ** 0.5
    # Sine and cosine of the angle of the line that touches the sphere from above.
    sine, cosine = along * tangent + beside * radius, beside * tangent - along * radius
    line = drift * max(0.0, sine / far) if cosine > 0 else drift
    return min(vertex, line)


def motion(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> Motion:
    """What to do to bounds when centroids move; ``radius`` bounds each cluster around ``before``."""
    old, new = before.astype(np.float64), after.astype(np.float64)
    k = len(new)
    drift = np.sqrt(((new - old) ** 2).sum(axis=1))
    loosening = np.array([
        max((approach(old[i], radius[i], old[j], new[j]) for j in range(k) if j != i), default=0.0)
        for i in range(k)])
    between = np.sqrt(((new[:, None] - new[None]) ** 2).sum(axis=2))
    np.fill_diagonal(between, np.inf)
    return Motion(after, drift, loosening, between.min(axis=1, initial=np.inf))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _scanned(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, the smaller number on ties, its distance and that of the next."""
    squared = squared_distances(vectors, centroids)
    nearest = squared.argmin(axis=1)
    rows = np.arange(len(vectors))
    least = squared[rows, nearest].astype(np.float64)
    if squared.shape[1] == 1:
        return nearest, np.sqrt(least), np.full(len(rows), np.inf)
    squared[rows, nearest] = np.iinfo(np.int64).max
    return nearest, np.sqrt(least), np.sqrt(squared.min(axis=1).astype(np.float64))


def reassign(vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray,
             move: Motion) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Clusters and bounds after a move, and which vectors were scanned against all centroids."""
    upper = (upper + move.drift[cluster]) * (1 + _SLACK)
    lower = (lower - move.loosening[cluster]) * (1 - _SLACK) - _SLACK

    def open_rows(rows: np.ndarray) -> np.ndarray:
        gap = move.gap[cluster[rows]] * (1 - _SLACK) - upper[rows]
        lower[rows] = np.maximum(lower[rows], gap)
        return rows[~(upper[rows] * (1 + _SLACK) < lower[rows])]

    rows = open_rows(np.arange(len(cluster)))
    own = vectors[rows] - move.centroids[cluster[rows]]
    upper[rows] = np.sqrt((own * own).sum(axis=1).astype(np.float64)) * (1 + _SLACK)
    rows = open_rows(rows)
    if len(rows):
        cluster[rows], near, following = _scanned(vectors[rows], move.centroids)
        upper[rows], lower[rows] = near * (1 + _SLACK), following * (1 - _SLACK)
    scanned = np.zeros(len(cluster), np.int32)
    scanned[rows] = 1
    return cluster, upper, lower, scanned


def _assigned(rows: DataFrame, move: Motion) -> DataFrame:
    """``rows`` with clusters and bounds; without any from before, every vector is scanned."""
    shared = rows.sparkSession.sparkContext.broadcast(move)
    fresh = "cluster" not in rows.columns
    keep = [c for c in rows.columns if c not in ("cluster", "upper", "lower", "scanned")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema), _STATE])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move = shared.value
        for batch in batches:
            vectors = _matrix(batch.column("vector"))
            n = batch.num_rows
            if n and fresh:
                cluster, upper, lower = _scanned(vectors, move.centroids)
                upper, lower, scanned = upper * (1 + _SLACK), lower * (1 - _SLACK), np.ones(n, np.int32)
            elif n:
                bounds = [batch.column(c).to_numpy().astype(kind) for c, kind in (
                    ("cluster", np.int64), ("upper", np.float64), ("lower", np.float64))]
                cluster, upper, lower, scanned = reassign(vectors, *bounds, move)
            else:
                cluster = upper = lower = scanned = np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(cluster.astype(np.int32)),
                 pa.array(upper.astype(np.float32)), pa.array(lower.astype(np.float32)),
                 pa.array(scanned.astype(np.int32))],
                names=[*keep, "cluster", "upper", "lower", "scanned"])

    return rows.mapInArrow(assign, schema)


def _sums(assigned: DataFrame, k: int, axes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums per cluster and axis as integers of any size, numbers of vectors, greatest upper bounds.

    Each task sends one row per cluster, however many vectors it read.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, radius = np.zeros((k, axes), np.int64), np.zeros(k, np.int64), np.zeros(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster = batch.column("cluster").to_numpy()
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            sums[found] += np.add.reduceat(_matrix(batch.column("vector"))[order], first)
            n += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, batch.column("upper").to_numpy().astype(np.float64))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(radius[some]),
             pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "radius", "sums"])

    parts = assigned.select("cluster", "vector", "upper").mapInArrow(
        add, "cluster int, n long, radius double, sums array<long>")
    totals = parts.select("cluster", "n", "radius", F.posexplode("sums").alias("axis", "part")).groupBy(
        "cluster", "axis").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"),
                               F.sum("n").alias("n"), F.max("radius").alias("radius"))
    sums, n, radius = np.zeros((k, axes), object), np.zeros(k, np.int64), np.zeros(k)
    for row in totals.collect():
        sums[row.cluster, row.axis] = int(row.total)
        n[row.cluster], radius[row.cluster] = row.n, row.radius
    return sums, n, radius


def cluster_vectors(vectors: DataFrame, start: np.ndarray, rounds: int = ROUNDS,
                    scans: list[int] | None = None) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` with ``cluster``, and the final centroids, after ``rounds`` of assignment and
    update and one last assignment.

    ``vector`` holds arrays of integers, each as long as the rows of ``start``; other columns are
    kept. A vector belongs to the nearest centroid, of equally near ones to the smaller number; a
    centroid becomes the floor of its vectors' mean, one without vectors stays. ``scans`` takes how
    many vectors were measured against all centroids, round by round.
    """
    centroids = np.asarray(start, np.int64)
    rest = np.zeros(len(centroids))
    state = settle(_assigned(vectors, Motion(centroids, rest, rest, rest)))
    for _ in range(rounds):
        sums, n, radius = _sums(state, *centroids.shape)
        if scans is not None:
            scans.append(state.agg(F.sum("scanned")).first()[0] or 0)
        moved = centroids.copy()
        for i in np.flatnonzero(n):
            moved[i] = [int(total) // int(n[i]) for total in sums[i]]
        if (moved == centroids).all():
            # From here on every round would repeat this one.
            break
        before, state = state, settle(_assigned(state, motion(centroids, moved, radius)))
        discard(before)
        centroids = moved
    return state.drop("upper", "lower", "scanned"), centroids


def integer_vectors(table: DataFrame, vector: str = "embedding", axes: int = AXES,
                    scale: int = SCALE) -> DataFrame:
    """Rows whose vector has ``axes`` finite components, with it as ``vector`` of scaled floors."""
    whole = (F.size(vector) == axes) & F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def component(x: Column) -> Column:
        return F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")

    return table.filter(F.coalesce(whole, F.lit(False))).withColumn("vector", F.transform(vector, component))


def first_centroids(vectors: DataFrame, key: str = "vec_id", k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose SHA-256 of seed and key is least; rows of one key by their vectors."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    chosen = vectors.select("vector", F.sha2(name, 256).alias("order")).orderBy("order", "vector").limit(k)
    return np.array([row.vector for row in chosen.collect()], np.int64)


_DIGEST = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clustered(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector kept.

    Vectors that are null, not of 64 components, or with a null, NaN or infinite one are left out.
    Components are the floors of 256 times theirs, at most ``LARGEST`` away from 0. With fewer
    vectors than ``k`` each starts a cluster; repeated rows each count, and rows of one vec_id, or
    without one, are vectors of their own. An inertia beyond a long is null. No vector at all gives
    an empty result. Only vec_id and embedding are read.
    """
    vectors = settle(integer_vectors(table.select("vec_id", "embedding")).select("vec_id", "vector"))
    start = first_centroids(vectors, k=k)
    if not len(start):
        return table.sparkSession.createDataFrame([], _DIGEST)
    assigned, centroids = cluster_vectors(vectors, start, rounds)
    shared = table.sparkSession.sparkContext.broadcast(centroids)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster")
            away = _matrix(batch.column("vector")).reshape(batch.num_rows, -1)
            if batch.num_rows:
                away = away - shared.value[cluster.to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), cluster, pa.array((away * away).sum(axis=1).astype(np.int64))],
                names=["vec_id", "cluster", "distance"])

    near = assigned.mapInArrow(measured, "vec_id long, cluster int, distance long")
    # One row per cluster, summed exactly.
    sums = settle(near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")),
                  rows=k)
    every = sums.agg(F.sum("total")).scalar()
    names = table.sparkSession.createDataFrame(
        [(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)], "cluster int, components string")
    of_cluster = names.join(sums, "cluster").select(
        "cluster", F.col("total").try_cast("long").alias("cluster_inertia"),
        every.try_cast("long").alias("inertia"), F.sha2("components", 256).alias("centroid_sha256"))
    return near.join(F.broadcast(of_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
