"""Centroid clustering with exact integer distances, screened by the norms of segments.

A vector is written once in whole numbers with a compressed form beside it: the
norm of each segment of its components. By Cauchy-Schwarz the product of two
vectors is at most the sum of the products of their segments' norms, so
`|x|^2 + |c|^2 - 2 sum |x_b| |c_b|` is never above the squared distance of x and
c. A centroid whose bound is above a distance already known is left out; only
the others get an exact distance, in 64-bit whole numbers.

A round is one pass: tasks keep one sum a centroid, and what reaches the driver
is one row for each centroid and component, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrado.llm.common import drop_table, materialize

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Components in a segment.
SEGMENT = 8
#: Whole components beyond this would let a squared distance of 64 components leave 64 bits.
FAR = 1 << 27
#: Share of the norms that a bound gives way by, so that rounding of its doubles never screens out a nearest centroid.
SLACK = 1e-9
KEPT = "vec_id long, v binary, norms binary, square long"


def whole_numbers(vectors: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an Arrow list column that can be used, and their components as whole numbers (floor of scale times each)."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dims)
    flat = vectors.take(pa.array(rows)).flatten() if len(rows) else pa.array([], pa.float64())
    x = np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(np.float64), nan=np.inf).reshape(len(rows), dims)
    with np.errstate(over="ignore"):
        x = np.floor(scale * x)
    usable = (np.abs(x) <= FAR).all(axis=1) if dims else np.ones(len(rows), bool)
    return rows[usable], x[usable].astype(np.int64)


def segment_norms(x: np.ndarray, segment: int) -> np.ndarray:
    """Norm of each segment of each row."""
    starts = np.arange(0, x.shape[1], segment)
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, starts, axis=1)) if x.shape[1] else np.zeros((len(x), 0))


class Screen:
    """The nearest of some centroids for rows of vectors."""

    def __init__(self, centroids: np.ndarray, segment: int = SEGMENT):
        self.centroids, self.norms = centroids, segment_norms(centroids, segment)
        self.squares = (centroids * centroids).sum(axis=1)
        self.exact = self.all = 0  # distances computed, and pairs there were

    def nearest(self, x: np.ndarray, norms: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller) and the squared distance to it."""
        both = squares[:, None].astype(np.float64) + self.squares[None, :]
        bounds = both - 2 * (norms @ self.norms.T) - SLACK * both
        cluster = bounds.argmin(axis=1)  # the likeliest one first, so that the rest meet a small distance
        best = self._distances(x, cluster)
        self.exact += len(x)
        self.all += len(x) * len(self.centroids)
        first = cluster.copy()
        for k in range(len(self.centroids)):
            rows = np.flatnonzero((bounds[:, k] <= best) & (first != k))
            self.exact += len(rows)
            found = self._distances(x[rows], np.full(len(rows), k))
            nearer = (found < best[rows]) | ((found == best[rows]) & (k < cluster[rows]))
            best[rows[nearer]], cluster[rows[nearer]] = found[nearer], k
        return cluster, best

    def _distances(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        apart = x - self.centroids[cluster]
        return (apart * apart).sum(axis=1)


def _compressed(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: float, segment: int) -> DataFrame:
    """vec_id, v, norms, square of the rows that take part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_numbers(batch.column(1), dims, scale)
            norms = segment_norms(x, segment)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)).cast(pa.int64()),
                    pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()),
                    pa.array([r.tobytes() for r in norms.astype("<f8")], pa.binary()),
                    pa.array((x * x).sum(axis=1), pa.int64()),
                ],
                names=["vec_id", "v", "norms", "square"],
            )

    chosen = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    return chosen.mapInArrow(read, KEPT)


def _unpacked(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").astype(np.int64).reshape(n, dims)
    norms = np.frombuffer(b"".join(batch.column("norms").to_pylist()), "<f8").reshape(n, -1 if n and dims else 0)
    return x, norms, batch.column("square").to_numpy(zero_copy_only=False).astype(np.int64)


def seed_order(vec_id: Column) -> Column:
    """Lowercase hex SHA-256 of `1:<vec_id>`; a null id counts as the empty text."""
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(vec_id.cast("string"), F.lit(""))).cast("binary"), 256)


def _seeds(kept: DataFrame, k: int, dims: int) -> np.ndarray:
    first = kept.select("v", seed_order(F.col("vec_id")).alias("h")).orderBy("h", "v").limit(k).collect()
    return np.array([np.frombuffer(bytes(r.v), "<i4") for r in first], dtype=np.int64).reshape(len(first), dims)


def _sums(kept: DataFrame, centroids: np.ndarray, dims: int, segment: int) -> DataFrame:
    """cluster, at (component; -1: rows, -2: distances), total: summed in each task, then over the tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, totals = Screen(centroids, segment), {}
        for batch in batches:
            x, norms, squares = _unpacked(batch, dims)
            cluster, far = screen.nearest(x, norms, squares)
            for k in np.unique(cluster).tolist():
                mine = cluster == k
                # 2**20 rows of less than 2**28 each stay within 64 bits; Python's own numbers add the batches, and halves add distances
                low, high = int((far[mine] & 0xFFFFFFFF).sum()), int((far[mine] >> 32).sum())
                row = [(high << 32) + low, int(mine.sum()), *map(int, x[mine].sum(axis=0))]
                totals[k] = [a + b for a, b in zip(totals[k], row, strict=True)] if k in totals else row
        cells = [(k, at - 2, Decimal(total)) for k, row in totals.items() for at, total in enumerate(row)]
        columns = list(zip(*cells, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.decimal128(38, 0))],
            names=["cluster", "at", "total"],
        )

    return kept.mapInArrow(partial, "cluster int, at int, total decimal(38,0)").groupBy("cluster", "at").agg(F.sum("total").alias("total"))


def _collected(sums: DataFrame) -> dict[tuple[int, int], int]:
    """One row for each centroid and component: bounded by their numbers, not by the vectors'."""
    return {(r.cluster, r.at): int(r.total) for r in sums.collect()}


def fit_centroids(kept: DataFrame, *, clusters: int, rounds: int, dims: int, segment: int) -> np.ndarray:
    """Centroids after the rounds; a round's means are exact floors of sum over count."""
    centroids = _seeds(kept, clusters, dims)
    for _ in range(rounds if len(centroids) else 0):
        sums = _collected(_sums(kept, centroids, dims, segment))
        centroids = centroids.copy()
        for k in range(len(centroids)):
            if n := sums.get((k, -1)):
                centroids[k] = [sums[k, at] // n for at in range(dims)]
    return centroids


def cluster_vectors(
    df: DataFrame,
    *,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: float = SCALE,
    segment: int = SEGMENT,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, one row for each vector that takes part.

    A vector takes part if it has exactly `dims` components, none null or not
    finite, and none beyond 2**27 once scaled (its distances might leave 64
    bits). Centroids start as the vectors first in `seed_order`; of rows with one
    id the smaller bytes come first. Rows that repeat count each. Fewer vectors
    than clusters: each starts one. No vectors: no rows. An inertia beyond 64
    bits is null. Ids are integers; null ids stay null. Other columns of the
    frame play no part, whatever their names.
    """
    spark = df.sparkSession
    kept = materialize(_compressed(df, id_col, vector_col, dims, scale, segment))
    centroids = fit_centroids(kept, clusters=clusters, rounds=rounds, dims=dims, segment=segment)
    inertias = {k: n for (k, at), n in _collected(_sums(kept, centroids, dims, segment)).items() if at == -2} if len(centroids) else {}
    drop_table(kept)  # the vectors are read once more from their own table

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids, segment)
        for batch in batches:
            x, norms, squares = _unpacked(batch, dims)
            cluster, far = screen.nearest(x, norms, squares) if len(centroids) else (np.zeros(0, int), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"]
            )

    inertia = sum(inertias.values())
    facts = [
        (k, Decimal(inertias.get(k, 0)), Decimal(inertia), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for k, c in enumerate(centroids.tolist())
    ]
    about = spark.createDataFrame(facts, "cluster int, mine decimal(38,0), every decimal(38,0), centroid_sha256 string")
    placed = _compressed(df, id_col, vector_col, dims, scale, segment).mapInArrow(assign, "vec_id long, cluster int, distance long")
    return placed.join(F.broadcast(about), "cluster").select(  # as many rows as there are clusters
        "vec_id",
        "cluster",
        "distance",
        F.expr("try_cast(mine as long)").alias("cluster_inertia"),
        F.expr("try_cast(every as long)").alias("inertia"),
        "centroid_sha256",
    )
