"""Clusters around whole-number centroids, found by equal-average equal-variance search.

With k components, means m and M and deviations s and S (root of the summed squares
around the mean), the squared distance of two vectors is at least
k (m - M)**2 + (s - S)**2. Centroids are sorted by their mean. From a vector's own mean the search
goes outward on both sides: it ends where the first term alone exceeds the best distance,
and passes over a centroid where both terms do. What is left is compared in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgauge.llm.vectors import PART, matrices, part, stored, total, whole
from airgauge.session import fresh_folder

SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
DIM = 64
_ROOM = 1 << 30  # components below this over their number keep every term in 64 bits
_SLACK = 1 + 1e-9  # covers rounding in the deviations


@dataclass
class Centroids:
    """Centroids in the order of their component sums."""

    rows: np.ndarray  # whole numbers, int64 or Python's
    sums: np.ndarray
    deviations: np.ndarray | None  # doubles; none for numbers too large for them
    numbers: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Centroids:
        """Centroid 0, 1, ... in the rows of an array of Python integers."""
        sums = rows.sum(axis=1)
        order = np.array(sorted(range(len(rows)), key=lambda i: (sums[i], i)), np.int64)
        if max((abs(x) for x in rows.ravel()), default=0) < _ROOM // rows.shape[1]:
            small = rows[order].astype(np.int64)
            return cls(small, small.sum(axis=1), _deviations(small), order)
        return cls(rows[order], sums[order], None, order)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of each vector's nearest centroid, the squared distance, and how many distances it took."""
        table, sums, deviations = self.rows, self.sums, self.deviations
        if vectors.dtype == object or table.dtype == object:
            vectors, table, sums, deviations = vectors.astype(object), table.astype(object), sums.astype(object), None
        dim, last = vectors.shape[1], len(table) - 1
        own = vectors.sum(axis=1)
        spread = None if deviations is None else _deviations(vectors)
        right = np.searchsorted(sums, own)
        left = right - 1
        best = np.zeros(len(vectors), own.dtype)
        number = np.full(len(vectors), -1, np.int64)
        compared = 0
        open_ = np.arange(len(vectors))
        while len(open_):
            low, high = left[open_], right[open_]
            gap_low = own[open_] - sums[np.maximum(low, 0)]
            gap_high = sums[np.minimum(high, last)] - own[open_]
            lower = (low >= 0) & ((high > last) | (gap_low <= gap_high).astype(bool))
            gap = np.where(lower, gap_low, gap_high)
            # The nearer side's mean is too far, so all others are; or both sides are used up.
            found = number[open_] >= 0
            go = ((low >= 0) | (high <= last)) & ~(found & (gap * gap > dim * best[open_]).astype(bool))
            open_, lower, gap, found = open_[go], lower[go], gap[go], found[go]
            at = np.where(lower, left[open_], right[open_])
            left[open_[lower]] -= 1
            right[open_[~lower]] += 1
            use = np.ones(len(open_), bool)
            if deviations is not None:
                bound = gap.astype(np.float64) ** 2 / dim + (spread[open_] - deviations[at]) ** 2
                use = ~found | (bound <= best[open_] * _SLACK + 1e-6)
            ask, at = open_[use], at[use]
            apart = vectors[ask] - table[at]
            distance = (apart * apart).sum(axis=1)
            compared += len(ask)
            name = self.numbers[at]
            better = (number[ask] < 0) | (distance < best[ask]).astype(bool)
            better |= (distance == best[ask]).astype(bool) & (name < number[ask])
            best[ask[better]], number[ask[better]] = distance[better], name[better]
        return number, best, compared


def _deviations(rows: np.ndarray) -> np.ndarray:
    values = rows.astype(np.float64)
    return np.sqrt(((values - values.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))


def _numbers(values: np.ndarray, scale: int) -> np.ndarray:
    return whole(np.floor(values * scale), _ROOM // values.shape[1])


def first_centroids(rows: DataFrame, count: int, scale: int, dim: int) -> np.ndarray:
    """The ``count`` vectors whose ids have the smallest hashes; of equal ids the smaller bytes come first."""
    mark = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(mark, "data").limit(count).select("data").collect()
    values = np.array([np.frombuffer(bytes(r.data), np.float64) for r in first]).reshape(-1, dim)
    return whole(np.floor(values * scale), 0.0).astype(object)


def refined(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round over all vectors: floors of the exact means, empty ones as before."""
    count, dim = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast(Centroids.of(centroids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((count, dim), object), np.zeros(count, np.int64)
        for _, values in matrices(batches, dim):
            numbers = _numbers(values, scale)
            cluster, _, _ = shared.value.nearest(numbers)
            for k in np.unique(cluster).tolist():
                mine = numbers[cluster == k]
                sums[k] += mine.sum(axis=0).astype(object)
                counts[k] += len(mine)
        if counts.any():
            yield part((sums, counts))

    found = total(rows.select("data").mapInArrow(run, PART), lambda x, y: (x[0] + y[0], x[1] + y[1]))
    shared.destroy()
    if found is None:
        return centroids
    sums, counts = found
    return np.array([sums[k] // int(counts[k]) if counts[k] else centroids[k] for k in range(count)], object)


_long = np.iinfo(np.int64).max


def _longs(values: np.ndarray) -> pa.Array:
    if values.dtype != object:
        return pa.array(values)
    return pa.array([x if x <= _long else None for x in values.tolist()], pa.int64())


def clustered(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM
) -> DataFrame:
    """Cluster, distance and totals of every vector (vec_id, embedding) of ``dim`` components.

    Components become floor(scale * x). Null vectors, those of another length and those
    with null or non-finite components take no part; rows without a ``vec_id`` do, but are
    no first centroid while others can be; repeated rows count each. Fewer vectors than
    ``clusters`` give as many centroids; no vectors give no rows. Ties go to the smaller
    number. A distance or sum beyond 64 bits is null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stored(vectors, "clustered").where(F.col("dim") == dim).select("vec_id", "data")
    named = rows.where(F.col("vec_id").isNotNull())
    centroids = first_centroids(named, clusters, scale, dim)
    if len(centroids) < clusters:
        more = first_centroids(rows.where(F.col("vec_id").isNull()), clusters - len(centroids), scale, dim)
        centroids = np.concatenate([centroids, more]) if len(more) else centroids
    for _ in range(rounds if len(centroids) else 0):
        moved = refined(rows, centroids, scale)
        if (moved == centroids).all():
            break  # every further round would give the same
        centroids = moved
    shared = spark.sparkContext.broadcast(Centroids.of(centroids) if len(centroids) else None)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in matrices(batches, dim):
            cluster, distance, _ = shared.value.nearest(_numbers(values, scale))
            columns = [batch.column("vec_id"), pa.array(cluster, pa.int32()), _longs(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    folder = fresh_folder(spark, "assigned")
    rows.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint").write.parquet(folder)
    assigned = spark.read.parquet(folder)
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    known = F.count("distance") == F.count(F.lit(1))
    by_cluster = assigned.groupBy("cluster").agg(F.when(known, wide).alias("sum")).collect()
    sums = {r.cluster: r["sum"] for r in by_cluster}
    every = None if None in sums.values() else sum(map(int, sums.values()))
    facts = [
        (k, _fitting(sums.get(k, 0)), _fitting(every), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for k, c in enumerate(centroids.tolist())
    ]
    struct = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return assigned.join(F.broadcast(spark.createDataFrame(facts, struct)), "cluster")  # one row a centroid


def _fitting(value) -> int | None:
    return None if value is None or int(value) > _long else int(value)
