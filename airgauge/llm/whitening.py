"""Whitening of vectors: uncorrelated components of unit variance, from a QR of the centred rows.

Every task reduces its centred rows block by block to one upper triangle by QR, and
triangles are reduced in the same way until one is left, whose squared singular values
over the number of rows are the variances and whose right singular vectors the directions
(see ``bidiagonal``). The covariance itself, whose rounding would be that of the squares,
is never formed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgauge.llm import bidiagonal
from airgauge.llm.vectors import PART, matrices, part, stored, total, whole

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
_HALF = 24  # bits of the lower part of a number that is squared in two parts
_WIDEST = 10**38


@dataclass
class Whitening:
    """What turns whole numbers into whitened components."""

    count: int
    sums: np.ndarray  # Python's integers, one a dimension
    directions: np.ndarray  # dimensions x components, divided by the standard deviations
    explained: np.ndarray

    def apply(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whitened rows, and count * number - sum of each dimension in whole numbers."""
        apart = centred(numbers, self.count, self.sums)
        return (apart / self.count).astype(np.float64) @ self.directions, apart


def _numbers(values: np.ndarray, scale: int, shift: int) -> np.ndarray:
    numbers = whole(np.floor(values * scale), float(1 << 52))
    return numbers + shift


def centred(numbers: np.ndarray, count: int, sums: np.ndarray) -> np.ndarray:
    """count * number - sum, exactly; in 64 bits where that is enough."""
    if numbers.dtype != object:
        largest = int(np.abs(numbers).max(initial=0)) * count + max(map(abs, sums), default=0)
        if largest < 1 << 62:
            return numbers * count - sums.astype(np.int64)
    return numbers.astype(object) * count - sums


def squared_lengths(apart: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    if apart.dtype == object or np.abs(apart).max(initial=0) >= 1 << 51 or apart.shape[1] > 1 << 7:
        return [sum(x * x for x in row) for row in apart.astype(object).tolist()]
    high, low = apart >> _HALF, apart & ((1 << _HALF) - 1)
    sums = [(x * y).sum(axis=1).tolist() for x, y in ((high, high), (high, low), (low, low))]
    return [(a << 2 * _HALF) + (b << _HALF + 1) + c for a, b, c in zip(*sums)]


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def fit(rows: DataFrame, dim: int, components: int, scale: int, shift: int) -> Whitening | None:
    """The whitening of all stored vectors of ``dim`` components; None if there are none."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, np.zeros(dim, object)
        for _, values in matrices(batches, dim):
            numbers = _numbers(values, scale, shift)
            count += len(numbers)
            sums += numbers.sum(axis=0).astype(object)
        if count:
            yield part((count, sums))

    found = total(rows.mapInArrow(add, PART), lambda x, y: (x[0] + y[0], x[1] + y[1]))
    if found is None:
        return None
    count, sums = found

    def reduce_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = None
        for _, values in matrices(batches, dim):
            block = (centred(_numbers(values, scale, shift), count, sums) / count).astype(np.float64)
            triangle = _triangle(block if triangle is None else np.concatenate([triangle, block]))
        if triangle is not None:
            yield part(triangle)

    triangle = total(rows.mapInArrow(reduce_rows, PART), lambda x, y: _triangle(np.concatenate([x, y])))
    square = np.zeros((dim, dim))
    square[: len(triangle)] = triangle
    values, right = bidiagonal.directions(square)
    # Below this a direction holds nothing but the rounding of the largest one.
    real = np.sqrt(values) > dim * np.finfo(np.float64).eps * np.sqrt(values[0])
    take = np.flatnonzero(real)[:components]
    signs = np.sign(right[np.abs(right).argmax(axis=0), np.arange(dim)])
    chosen = (right * signs)[:, take] / np.sqrt(values[take] / count)
    return Whitening(count, sums, chosen, values[take] / values.sum() if len(take) else np.zeros(0))


def identity_error(rows: DataFrame, dim: int, model: Whitening, scale: int, shift: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured on all of them."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    size = model.directions.shape[1]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((size, size))
        some = False
        for _, values in matrices(batches, dim):
            white, _ = shared.value.apply(_numbers(values, scale, shift))
            products += white.T @ white  # the rows are centred already
            some = True
        if some:
            yield part(products)

    products = total(rows.mapInArrow(add, PART), lambda x, y: x + y)
    return float(np.abs(products / model.count - np.eye(size)).max(initial=0.0))


WHITENED = (
    "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, "
    "explained double, identity_error double"
)
_NAMES = [x.split()[0] for x in WHITENED.split(", ")]


def most_common_length(rows: DataFrame) -> int | None:
    found = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    return found.dim if found else None


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row for each vector (vec_id, embedding) and component.

    Components become x = floor(scale * c) + shift. Null and empty vectors and those with
    null or non-finite components take no part, nor do vectors of another length than most
    have (of equally many, the longer); rows without a ``vec_id`` and repeated rows count
    each. Components of no variance, as far as doubles can tell, are left out, so equal
    vectors, one vector or none give no rows. ``deviation`` is the exact sum over the
    dimensions of (n * x - sum of x)**2, null beyond 38 digits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stored(vectors, "whitened")
    dim = most_common_length(rows)
    rows = rows.where(F.col("dim") == dim).select("vec_id", "data")
    model = fit(rows, dim, components, scale, shift) if dim else None
    if model is None or not model.directions.shape[1]:
        return _none(spark)
    error = identity_error(rows, dim, model, scale, shift)
    shared = spark.sparkContext.broadcast(model)
    size = model.directions.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in matrices(batches, dim):
            white, apart = shared.value.apply(_numbers(values, scale, shift))
            length = [Decimal(x) if x < _WIDEST else None for x in squared_lengths(apart)]
            each = pa.array(np.repeat(np.arange(len(white)), size))
            columns = [
                batch.column("vec_id").take(each),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(white))),
                pa.array(np.full(white.size, shared.value.count, np.int64)),
                pa.array(length, pa.decimal128(38, 0)).take(each),
                pa.array(white.ravel()),
                pa.array(np.tile(shared.value.explained, len(white))),
                pa.array(np.full(white.size, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return rows.mapInArrow(run, WHITENED)


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], WHITENED)
