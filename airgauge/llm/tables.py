"""Fixed-size tables of counters, added up over all tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Rows that a task hands on for one table: ``counts`` are compressed 64-bit numbers.
COUNTERS = "key string, block int, salt int, size int, counts binary"
_SALTS = 64


def _packed(counts: np.ndarray) -> pa.Array:
    return pa.array([pa.compress(counts.astype("<i8").tobytes(), codec="zstd", asbytes=True)], pa.binary())


def _unpacked(size: int, raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw.as_buffer(), 8 * size, codec="zstd"), "<i8")


def counter_rows(key: str, counts: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """A task's table as rows of ``block`` counters; blocks of zeros are left out."""
    salt = TaskContext.get().partitionId() % _SALTS
    for number, part in enumerate(counts.reshape(-1, block)):
        if part.any():
            values = [pa.array([key]), *(pa.array([x], pa.int32()) for x in (number, salt, block)), _packed(part)]
            yield pa.RecordBatch.from_arrays(values, ["key", "block", "salt", "size", "counts"])


def summed(rows: DataFrame) -> DataFrame:
    """One row for each (key, block), its counters added up.

    The salt, the task's number within a fixed range, splits what would meet in one
    group, and is summed away in a second step.
    """

    def add(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        counts = np.zeros(size, np.int64)
        for raw in table.column("counts"):
            counts += _unpacked(size, raw)
        first = table.slice(0, 1)
        return first.set_column(first.schema.get_field_index("counts"), "counts", _packed(counts))

    salted = rows.groupBy("key", "block", "salt").applyInArrow(add, COUNTERS)
    return salted.groupBy("key", "block").applyInArrow(add, COUNTERS)


def collected(rows: DataFrame, sizes: int) -> dict[str, np.ndarray]:
    """The summed tables of ``sizes`` counters each, on the driver; their number must be bounded."""
    tables: dict[str, np.ndarray] = {}
    for row in rows.collect():
        table = tables.setdefault(row.key, np.zeros(sizes, np.int64))
        counts = _unpacked(row.size, pa.scalar(bytes(row.counts), pa.binary()))
        table[row.block * row.size : (row.block + 1) * row.size] = counts
    return tables


def sketch(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """How many of the 64-bit numbers in ``column`` fall in each of 2**bits buckets of their top bits."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            counts += np.bincount((numbers >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        yield from counter_rows("", counts, 1 << max(bits - 6, 0))

    found = collected(summed(rows.select(column).mapInArrow(count, COUNTERS)), 1 << bits)
    return found.get("", np.zeros(1 << bits, np.int64))
