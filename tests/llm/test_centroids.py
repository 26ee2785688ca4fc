"""Centroid clustering against plain integers, its bounds, and edge rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids
from tests.llm.test_operators import CLASH


def plain(rows, clusters, rounds):
    kept = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in order[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(x) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centers)]
    return [(i, *near(v)[::-1], hashlib.sha256(",".join(map(str, centers[near(v)[1]])).encode()).hexdigest()) for i, v in kept]


def test_rows_with_ties_repeats_and_unfit_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(rng.integers(-2, 3), 0.4, 64).astype("float32").tolist()) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [rows[3], rows[3], (None, rows[5][1]), (None, rows[6][1])]
    rows += [(300, None), (301, [1.0] * 63), (302, [1.0] * 65), (303, [float("nan")] + [0.0] * 63), (304, [float("inf")] + [0.0] * 63), (305, [None] + [0.0] * 63), (306, [])]
    rows += [(400, [0.0] * 64), (401, [0.0] * 64), (402, [-0.001] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit("x").alias(c) for c in CLASH])
    found = centroids.cluster(df, clusters=12, rounds=3).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in found], key=key) == sorted(plain(rows, 12, 3), key=key)
    assert {r.inertia for r in found} == {sum(r.distance for r in found)}
    for c in {r.cluster for r in found}:
        assert {r.cluster_inertia for r in found if r.cluster == c} == {sum(r.distance for r in found if r.cluster == c)}


def test_screening_spares_distances_and_changes_nothing():
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 300, (40, 64))
    whole = (middles[rng.integers(0, 40, 3000)] + rng.normal(0, 30, (3000, 64))).astype(np.int64)
    centers = middles.astype(np.int64)
    short = centroids.compressed(whole, 16)
    full = ((whole[:, None, :] - centers) ** 2).sum(axis=2)
    for guess in (np.zeros(3000, np.int64), full.argmin(axis=1), rng.integers(0, 40, 3000)):
        chosen, best, tested = centroids.nearest(whole, short, centers, 16, guess)
        assert (chosen == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert centroids.nearest(whole, short, centers, 16, full.argmin(axis=1))[2] < 3000 * 40 / 5


@pytest.mark.parametrize("size", [10, 10_000_000])
def test_bounds_never_exceed_distances(size):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-size, size, (200, 64)), rng.integers(-size, size, (40, 64))
    x, y = centroids.compressed(a, 8), centroids.compressed(b, 8)
    low = x[:, -1:] + y[:, -1] - 2 * (x[:, :-1] @ y[:, :-1].T)
    assert (low - 1e-9 * (x[:, -1:] + y[:, -1]) - 1 <= ((a[:, None] - b) ** 2).sum(axis=2)).all()


def test_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(empty).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None)], empty.schema)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"]
    few = centroids.cluster(spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], empty.schema)).collect()
    assert sorted((r.vec_id, r.distance) for r in few) == [(1, 0), (2, 0)]


def test_components_beyond_exact_distances_fail(spark):
    with pytest.raises(Exception, match="no exact distance"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).count()
