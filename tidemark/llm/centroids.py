"""Centroid clustering of integer vectors; bounds from block norms screen the exact distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Components beyond this can't be squared and summed in 64 bits.
LARGEST = 1 << 27


def compressed(whole: np.ndarray, blocks: int) -> np.ndarray:
    """Per block of components its mean, times the root of its length, and the norm of what the mean leaves; then the squared norm of all."""
    parts = whole.astype(np.float64).reshape(len(whole), blocks, -1)
    mean = parts.mean(axis=2)
    left = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))
    return np.concatenate([mean * np.sqrt(parts.shape[2]), left, (parts**2).sum(axis=(1, 2))[:, None]], axis=1)


def nearest(whole: np.ndarray, short: np.ndarray, centroids: np.ndarray, blocks: int, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (the smaller one of equals) and exact squared distance, per vector, and how many exact distances that took.

    By Cauchy and Schwarz a block's product is at most that of the means plus that of the norms of the rest, so the
    compressed vectors bound every distance from below. ``guess`` names a centroid whose exact distance is taken first;
    of the others only those whose bound isn't above it are computed.
    """
    rows = np.arange(len(whole))
    tight = compressed(centroids, blocks)
    low = short[:, -1:] + tight[:, -1] - 2 * (short[:, :-1] @ tight[:, :-1].T)
    low -= 1e-9 * (short[:, -1:] + tight[:, -1]) + 1  # what rounding may have added
    best = ((whole - centroids[guess]) ** 2).sum(axis=1)
    chosen = guess.copy()
    tested = len(whole)
    for c in range(len(centroids)):
        open_ = rows[(low[:, c] <= best) & (guess != c)]
        if len(open_):
            exact = ((whole[open_] - centroids[c]) ** 2).sum(axis=1)
            better = (exact < best[open_]) | ((exact == best[open_]) & (c < chosen[open_]))
            best[open_[better]], chosen[open_[better]] = exact[better], c
            tested += len(open_)
    return chosen, best, tested


def quantized(vectors: DataFrame, *, id_col: str, vector_col: str, size: int, scale: int, blocks: int) -> DataFrame:
    """Kept vectors as integers with their compressed form: id, whole, short."""
    kept = (F.size(vector_col) == size) & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kind = vectors.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
            if whole.size and np.abs(whole).max() >= LARGEST:
                raise ValueError(f"a component beyond {LARGEST // scale} has no exact distance in 64 bits")
            whole = whole.astype(np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (whole, compressed(whole, blocks))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "whole", "short"])

    return vectors.where(kept).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, f"id {kind}, whole array<int>, short array<double>")


def seeds(vectors: DataFrame, *, clusters: int, seed: str) -> np.ndarray:
    """First centroids: the vectors with the smallest digests of seed and id; equal ids by their components, null ids last.

    Only digests below a bound are ordered, one that some more than ``clusters`` vectors fall below on average; it rises until as many
    do. Equal vectors of an id are counted before that, so what reaches the driver doesn't grow with the table.
    """
    drawn = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("draw"), "whole")
    share = (4 * clusters + 100) / max(1, vectors.count())
    while True:
        below = drawn if share >= 1 else drawn.where(F.col("draw") < f"{int(share * 2**32):08x}")
        rows = below.groupBy("draw", "whole").agg(F.count("*").alias("n")).orderBy(F.col("draw").asc_nulls_last(), "whole").limit(clusters).collect()
        first = [r["whole"] for r in rows for _ in range(min(clusters, r["n"]))][:clusters]
        if len(first) == clusters or share >= 1:
            return np.array(first, np.int64)
        share *= 8


def assigned(vectors: DataFrame, centroids: np.ndarray, blocks: int) -> DataFrame:
    """id, cluster, distance, whole: every vector with its nearest centroid."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            whole, short = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for k in ("whole", "short"))
            whole = whole.astype(np.int64)
            rough = short[:, -1:] - 2 * (short[:, :-1] @ compressed(centroids, blocks)[:, :-1].T) + (centroids**2).sum(axis=1)
            cluster, distance, _ = nearest(whole, short, centroids, blocks, rough.argmin(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance), batch.column("whole")], names=["id", "cluster", "distance", "whole"])

    return vectors.mapInArrow(run, f"id {kind}, cluster int, distance long, whole array<int>")


def moved(found: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids replaced by their vectors' componentwise floor of the mean; one row per cluster reaches the driver."""
    sums = found.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("whole")[k].cast("long")).alias(f"s{k}") for k in range(centroids.shape[1])])
    centroids = centroids.copy()
    for row in sums.collect():
        centroids[row["cluster"]] = [row[f"s{k}"] // row["n"] for k in range(centroids.shape[1])]
    return centroids


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, clusters: int = 40, rounds: int = 5, scale: int = 256, blocks: int = 16, seed: str = "2") -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, centroid.

    Vectors of ``size`` components, none null or not finite, become integers floor(scale * x); all else is exact.
    Quantized vectors and their block norms are written once and read in each round; what reaches the driver is
    ``clusters`` rows of sums a round.

    Null, short or long vectors, and vectors with a null, NaN or infinite component: not kept. Null ids: kept, and
    drawn last as first centroids. Repeated rows: a row each. Ties: the smaller number. Fewer vectors than clusters: as
    many clusters as vectors. A cluster without vectors keeps its centroid. Empty table: empty result. A component whose
    distance can't be exact in 64 bits fails the query. Other columns are not read.
    """
    kept = materialize(quantized(vectors, id_col=id_col, vector_col=vector_col, size=size, scale=scale, blocks=blocks))
    centroids = seeds(kept, clusters=clusters, seed=seed).reshape(-1, size)
    if not len(centroids):
        kind = vectors.select(id_col).schema[0].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    for _ in range(rounds):
        centroids = moved(assigned(kept, centroids, blocks), centroids)
    found = materialize(assigned(kept, centroids, blocks).drop("whole"))
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    spark = vectors.sparkSession
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), [int(x) for x in centroids[c]]) for c in range(len(centroids))]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    known = known.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256))
    out = found.join(F.broadcast(known), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
