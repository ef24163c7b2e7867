"""Shards along a Hilbert curve through quantised metadata.

Rows that lie close on the curve are alike in every dimension, so a run of the curve
has narrow ranges in all of them, and readers can leave out shards by their minima and maxima.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgauge.operators.running import ONE_TASK_ROWS, running_totals
from airgauge.session import settle

BITS = 5
SHARDS = 8


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows x dimensions, below 2**bits)."""
    x = [column.astype(np.int64) for column in cells.T]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            # Upper half of a dimension: the first is mirrored. Lower half: both swap.
            upper = (x[i] & bit) > 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    index = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for column in x:
            index = (index << 1) | (((column ^ turn) >> level) & 1)
    return index


def cut_points(rows: DataFrame, value: Column, cells: int) -> list:
    """Values at which ``value`` is cut so that at most ``cells`` parts hold about equally many rows.

    Equal values are counted first, whatever their type and length, and running totals over
    their order tell which of them lie on a cut. Fewer than ``cells`` values go to the driver.
    """
    counts = settle(rows.select(value.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    ranked = running_totals(counts, ["v"], "n", sliced=counts.count() > ONE_TASK_ROWS)
    first = F.greatest(F.lit(1), F.expr(f"(before * {cells} + total - 1) div total"))
    hit = first * F.col("total") < (F.col("before") + F.col("n")) * cells
    return sorted(r.v for r in ranked.where(hit & (first < cells)).select("v").collect())


def with_curve(rows: DataFrame, dimensions: dict[str, Column], bits: int = BITS) -> DataFrame:
    """``rows`` with ``curve``, from ``dimensions`` cut at their quantiles over all rows.

    Whole values are compared, texts byte by byte. Null stands in the lowest cell.
    """
    names = []
    for name, column in dimensions.items():
        cuts = cut_points(rows, column, 1 << bits)
        above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < column)) if cuts else F.lit(0)
        names.append(f"_cell_{name}")
        rows = rows.withColumn(names[-1], F.when(column.isNull(), 0).otherwise(above).cast("int"))
    kept = [x for x in rows.columns if x not in names and x != "curve"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.stack([batch.column(name).to_numpy() for name in names], axis=1)
            columns = [*map(batch.column, kept), pa.array(curve_index(cells, bits))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "curve"])

    schema = rows.select(*kept, F.lit(0).cast("bigint").alias("curve")).schema
    return rows.select(*kept, *names).mapInArrow(run, schema)


def sharded(rows: DataFrame, order: Sequence[str], shards: int = SHARDS, weight: str | None = None) -> DataFrame:
    """``rows`` cut into runs of ``order``, with ``shard`` and ``slot``.

    Without ``weight`` the shards' row counts differ by one at most; with it, their sums of
    ``weight`` by no more than its largest value twice. ``order`` must tell all rows apart.
    Rows are dealt by ranges of it and written down; only one total for each range is added
    up in order.
    """
    dealt = settle(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        # The partition's number, and the row's number in it.
        .withColumn("_at", F.monotonically_increasing_id())
    )
    dealt = dealt.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    each = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    totals = dealt.groupBy("_part").agg(F.sum(each).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "_part",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_sum").over(Window.partitionBy()).alias("_total"),
    )
    if weight is None:
        ranked = dealt.join(F.broadcast(bases), "_part").withColumn("_before", F.col("_base") + F.col("_row"))
    else:
        inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        ranked = dealt.withColumn("_inside", F.coalesce(F.sum(each).over(inside), F.lit(0))).join(
            F.broadcast(bases), "_part"
        )
        ranked = ranked.withColumn("_before", F.col("_base") + F.col("_inside"))
    placed = ranked.withColumn("shard", F.expr(f"least({shards - 1}, _before * {shards} div greatest(_total, 1))").cast("int"))
    if weight is None:
        slot = F.expr(f"_before - (shard * _total + {shards - 1}) div {shards}")
        return placed.withColumn("slot", slot.cast("bigint")).drop("_at", "_part", "_row", "_base", "_total", "_before")
    counts = placed.groupBy("shard", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    prior = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        "shard", "_part", (F.coalesce(F.sum("_n").over(prior), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    slotted = placed.join(F.broadcast(firsts), ["shard", "_part"]).withColumn("slot", F.col("_row") + F.col("_shift"))
    return slotted.drop("_at", "_part", "_row", "_base", "_total", "_before", "_inside", "_shift")


def shard_documents(docs: DataFrame, shards: int = SHARDS, law: str = "rows", bits: int = BITS) -> DataFrame:
    """Shard and slot of every document (doc_id, text, lang, source), by language, source and size.

    ``law`` is ``rows`` (row counts differ by one at most) or ``bytes`` (sizes are about
    equal). ``size`` is the text's UTF-8 bytes plus one. Equal texts stand together along the
    curve as far as their language and source are in the same cells. Null texts are empty; null metadata is the lowest cell; repeated rows are
    placed each; other columns are ignored. ``docs`` must be a stored table.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    payload = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        (F.octet_length(payload) + 1).cast("bigint").alias("size"),
        F.crc32(payload).alias("text_crc32"),
        F.col("lang").cast("string"),
        F.col("source").cast("string"),
        F.monotonically_increasing_id().alias("place"),
    )
    dimensions = {name: F.col(name) for name in ("lang", "source", "size")}
    curved = with_curve(rows, dimensions, bits)
    placed = sharded(curved, ["curve", "text_crc32", "doc_id", "place"], shards, None if law == "rows" else "size")
    return placed.withColumn("law", F.lit(law)).drop("place")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, bits: int = BITS) -> None:
    """Write ``docs`` (its columns, and ``shard``) to one folder for each shard, along the curve.

    A shard's rows are spread over as many tasks as its share of the curve has.
    """
    payload = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    rows = docs.select(
        F.struct(*docs.columns).alias("_row_"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(payload) + 1).cast("bigint").alias("size"),
        F.crc32(payload).alias("tie"),
        F.monotonically_increasing_id().alias("place"),
    )
    dimensions = {name: F.col(name) for name in ("lang", "source", "size")}
    placed = sharded(with_curve(rows, dimensions, bits), ["curve", "tie", "place"], shards, "size")
    placed.select("_row_.*", "shard").write.partitionBy("shard").parquet(folder)
