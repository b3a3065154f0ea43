"""Centroid clustering of integer vectors by Elkan's bounds.

Every vector keeps an upper bound of the distance to its own centroid and k lower bounds,
one for each centroid, from round to round.  A centroid is skipped where a bound, or half
its distance from the vector's own centroid, shows that it lies strictly farther away.
Bounds are 32-bit numbers rounded to the safe side and every comparison that skips is
strict, so ties are always computed; what is computed is exact in 64-bit integers.

Vectors are never shuffled: a round reads the last round's state, part by part, and writes
the next one with the sums of each part's clusters; only those sums (k rows a task,
added up by Spark) and the k centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import delete, stored

#: Largest component (after scaling): squared distances of 64 components then fit a long.
LARGEST = 1 << 27
STATE = "vec_id long, vector array<int>, cluster int, upper float, lower array<float>, n long, sums array<long>"
STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]


def _up(x: np.ndarray) -> np.ndarray:
    """32-bit numbers that are not below x."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """32-bit numbers from 0 that are not above x."""
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x.astype(np.int64) - y
    return np.einsum("ij,ij->i", gap, gap)


class Geometry:
    """Centroids, half their distances from each other, and how far each has moved."""

    def __init__(self, centers: np.ndarray, before: np.ndarray | None = None):
        self.centers = centers
        k = len(centers)
        self.half = np.full((k, k), np.inf, np.float32)
        for c in range(k):
            self.half[c] = _down(np.sqrt(_squares(centers, centers[c]).astype(float)) / 2)
        np.fill_diagonal(self.half, np.inf)
        self.near = self.half.min(axis=1)
        self.moved = np.zeros(k) if before is None else _up(np.sqrt(_squares(centers, before).astype(float))).astype(float)

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Move bounds by the centroids' steps, then own, upper and lower to the nearest centroid (ties: smaller number), in place."""
        upper[:] = _up(upper.astype(float) + self.moved[own])
        lower[:] = _down(lower.astype(float) - self.moved)
        at = np.flatnonzero(upper >= self.near[own])
        if not len(at):
            return
        x, a, low = x[at], own[at], lower[at]
        best = _squares(x, self.centers[a])
        u = _up(np.sqrt(best.astype(float)))
        low[np.arange(len(at)), a] = _down(np.sqrt(best.astype(float)))
        for c in range(len(self.centers)):
            rows = np.flatnonzero((a != c) & (u >= low[:, c]) & (u >= self.half[a, c]))
            if not len(rows):
                continue
            d = _squares(x[rows], self.centers[c])
            low[rows, c] = _down(np.sqrt(d.astype(float)))
            better = (d < best[rows]) | ((d == best[rows]) & (c < a[rows]))
            rows, d = rows[better], d[better]
            a[rows], best[rows], u[rows] = c, d, _up(np.sqrt(d.astype(float)))
        own[at], upper[at], lower[at] = a, u, low


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).copy()


def _placed(batch: pa.RecordBatch, g: Geometry) -> tuple[np.ndarray, ...]:
    """(x, own, upper, lower) of a batch after one assignment; without bounds yet, they are as wide as can be."""
    k, width = g.centers.shape
    x = _matrix(batch.column(1), width)
    if batch.num_columns == 2:
        own, upper, lower = np.zeros(len(x), np.int32), np.full(len(x), np.inf, np.float32), np.zeros((len(x), k), np.float32)
    else:
        own, upper = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3))
        lower = _matrix(batch.column(4), k)
    g.assign(x, own, upper, lower)
    return x, own, upper, lower


def _round(g: Geometry) -> Callable:
    """State rows of the next round, then one row for each cluster of the part: its size and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = g.centers.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            x, own, upper, lower = _placed(batch, g)
            count += np.bincount(own, minlength=k)
            for c in np.unique(own):
                total[c] += x[own == c].sum(axis=0, dtype=np.int64)
            nothing = [pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.list_(pa.int64()))]
            made = [batch.column(0), batch.column(1), pa.array(own), pa.array(upper), _lists(lower, pa.float32())]
            yield pa.RecordBatch.from_arrays([*made, *nothing], names=STATE_NAMES)
        some = np.flatnonzero(count)
        empty = [pa.nulls(len(some), t) for t in (pa.int64(), pa.list_(pa.int32()), pa.float32(), pa.list_(pa.float32()))]
        sums = [pa.array(count[some]), _lists(total[some], pa.int64())]
        yield pa.RecordBatch.from_arrays([*empty[:2], pa.array(some.astype(np.int32)), *empty[2:], *sums], names=STATE_NAMES)

    return run


def _last(g: Geometry) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own, _, _ = _placed(batch, g)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(_squares(x, g.centers[own]))], names=["vec_id", "cluster", "distance"])

    return run


def integer_vectors(embeddings: DataFrame, width: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, vector: floor(scale * component) of the rows with exactly ``width`` finite components."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    fits = lambda v: F.when(F.abs(v * scale) <= LARGEST, F.floor(v * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}")).cast("int"))
    return rows.where((F.size("x") == width) & F.coalesce(finite, F.lit(False))).select("vec_id", F.transform("x", fits).alias("vector"))


def _means(state: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Componentwise exact floor of sum / count; empty clusters keep their centroid.  At most k rows come to the driver."""
    sums = F.array(*(F.sum(F.col("sums")[j].cast("decimal(38,0)")) for j in range(centers.shape[1])))
    out = centers.copy()
    for row in state.where("n is not null").groupBy("cluster").agg(F.sum("n").alias("n"), sums.alias("sums")).collect():
        out[row.cluster] = [int(s) // row.n for s in row.sums]
    return out


def cluster_vectors(embeddings: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    embeddings: vec_id, embedding; other columns are ignored.  Rows without exactly
    ``width`` components, or with a null, NaN or infinite one, are left out; a component
    whose scaled floor is beyond LARGEST raises, as distances might not fit a long.  The k
    first centroids are the vectors of smallest sha256 of ``salt`` and vec_id; rows that
    repeat a vec_id are rows of their own (as centroids in order of their components), null
    ids come last.  With fewer than k vectors all are centroids; an empty table gives an
    empty result.
    """
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings, width, scale)
    mark = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(mark.asc_nulls_last(), "vector").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    g, state, path = Geometry(np.array([r.vector for r in first], np.int64)), vectors, None
    for _ in range(rounds):
        made, place = stored(state.mapInArrow(_round(g), STATE), "elkan")
        g = Geometry(_means(made, g.centers), g.centers)
        state = made.where("n is null").select("vec_id", "vector", "cluster", "upper", "lower")
        if path:
            delete(spark, path)
        path = place
    found, _ = stored(state.mapInArrow(_last(g), "vec_id long, cluster int, distance long"), "clusters")
    if path:
        delete(spark, path)
    parts = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(parts.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in g.centers.tolist()]
    known = spark.createDataFrame([(c, s, whole, names[c]) for c, s in parts.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
