"""Whole vectors as Arrow batches and numpy matrices, and totals added up over all tasks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgauge.session import fresh_folder

#: A task's part of a total: ``data`` is pickled.
PART = "salt int, data binary"
_SALTS = 1024
_ROWS = 8192  # rows of a batch that are handled at a time

_to_int = np.frompyfunc(int, 1, 1)


def _stored_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("embedding")
        lengths = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
        ends = np.cumsum(np.maximum(lengths, 0))
        wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        starts = ends - np.maximum(lengths, 0)
        keep = np.flatnonzero((lengths > 0) & (wrong[ends] == wrong[starts]))
        data = [values[starts[i] : ends[i]].tobytes() for i in keep.tolist()]
        columns = [
            batch.column("vec_id").take(pa.array(keep)),
            pa.array(lengths[keep], pa.int32()),
            pa.array(data, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "data"])


def stored(vectors: DataFrame, label: str) -> DataFrame:
    """(vec_id, dim, data) of the vectors without null or non-finite components, written once.

    ``data`` are the components as doubles, which later passes read without looking at
    single values. Null and empty vectors are left out; a null ``vec_id`` stays.
    """
    spark = vectors.sparkSession
    folder = fresh_folder(spark, label)
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding"))
    kept = rows.mapInArrow(_stored_rows, "vec_id bigint, dim int, data binary")
    kept.write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def matrices(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of stored vectors of one length, cut to size, each with its matrix of doubles."""
    for batch in batches:
        for low in range(0, batch.num_rows, _ROWS):
            piece = batch.slice(low, _ROWS)
            raw = b"".join(piece.column("data").to_pylist())
            yield piece, np.frombuffer(raw, np.float64).reshape(-1, dim)


def whole(values: np.ndarray, limit: float) -> np.ndarray:
    """Whole doubles as 64-bit integers if all are below ``limit``, else as Python's own integers."""
    if np.abs(values).max(initial=0) < limit:
        return values.astype(np.int64)
    return _to_int(values)


def part(value: Any) -> pa.RecordBatch:
    """A task's part of a total as its only row."""
    salt = TaskContext.get().partitionId() % _SALTS
    columns = [pa.array([salt], pa.int32()), pa.array([pickle.dumps(value, pickle.HIGHEST_PROTOCOL)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["salt", "data"])


def total(parts: DataFrame, add: Callable[[Any, Any], Any]) -> Any:
    """All parts added up, None if there are none; only the total reaches the driver.

    Tasks are added up in groups of fixed number first, so that no task meets them all.
    """

    def merge(table: pa.Table) -> pa.Table:
        values = (pickle.loads(x.as_buffer()) for x in table.column("data"))
        data = pickle.dumps(reduce(add, values), pickle.HIGHEST_PROTOCOL)
        return pa.table({"salt": pa.array([0], pa.int32()), "data": pa.array([data], pa.binary())})

    grouped = parts.groupBy("salt").applyInArrow(merge, PART)
    found = grouped.groupBy("salt").applyInArrow(merge, PART).collect()
    return pickle.loads(found[0].data) if found else None

