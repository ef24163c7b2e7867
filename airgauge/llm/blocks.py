"""Patched frame-of-reference files of token ids.

A file is a run of segments, in the order of the documents. A segment holds

* a header of nine unsigned 32-bit numbers: magic, bytes of the segment, part number,
  number in the part, documents, tokens, blocks, values in a block, bytes of payload;
* for each document its id (64 bits), whether it has one (8 bits), its tokens (32 bits);
* for each block the byte at which it starts in the payload (32 bits);
* the payload: for each block its minimum (32 bits), bit width (8), number of
  exceptions (16), the values less the minimum packed at that width, then the
  exceptions' positions (16 bits each) and their whole values less the minimum (32);
* one line feed, which the text writer of Spark puts after every row.

All numbers are little-endian. The width is the one that holds ``share`` of a block's
values; the others are exceptions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airgauge.llm.bytewise import batches_by_bytes, ragged
from airgauge.llm.tokens import encoder, with_end
from airgauge.session import fresh_folder, settle

MAGIC = 0x31524650
BLOCK = 256
SHARE = 0.9
SEGMENT_TOKENS = 1 << 20
SEGMENTS_PER_FILE = 8
_HEAD = 9 * 4


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Payload bytes, and the byte at which each block starts."""
    count = -(-len(ids) // block)
    if not count:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    lengths = np.full(count, block)
    lengths[-1] = len(ids) - block * (count - 1)
    table = np.full(count * block, ids[-1], np.uint32)  # the last block is filled up with its last value
    table[: len(ids)] = ids
    table = table.reshape(count, block)
    low = table.min(axis=1)
    table = table - low[:, None]
    bits = _bits(table.ravel()).reshape(count, block)
    widths = np.partition(bits, int(np.ceil(block * share)) - 1, axis=1)[:, int(np.ceil(block * share)) - 1]
    odd = bits > widths[:, None]
    odd[-1, lengths[-1] :] = False
    counts = odd.sum(axis=1)
    packed_size = -(-block * widths // 8)
    sizes = 7 + packed_size + 6 * counts
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(count, 4)
    out[starts + 4] = widths
    out[starts[:, None] + np.arange(5, 7)] = counts.astype("<u2").view(np.uint8).reshape(count, 2)
    for width in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == width)
        size = -(-block * width // 8)
        for part in np.array_split(rows, -(-len(rows) // 512)):
            flags = (table[part][:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
            packed = np.packbits(flags.astype(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
            out[starts[part][:, None] + 7 + np.arange(size)] = packed
    row, position = np.nonzero(odd)
    rank = ragged(np.zeros(count, np.int64), counts)
    at = starts[row] + 7 + packed_size[row]
    out[(at + 2 * rank)[:, None] + np.arange(2)] = position.astype("<u2").view(np.uint8).reshape(-1, 2)
    at = at + 2 * counts[row] + 4 * rank
    out[at[:, None] + np.arange(4)] = table[row, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, starts


def _numbers(data: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """Numbers of ``kind`` that start at the given bytes."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(data[at[:, None] + np.arange(size)]).view(kind)[:, 0]


def decode_blocks(payload: np.ndarray, starts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Values of the blocks that start at the given bytes, whole blocks each."""
    low = _numbers(payload, starts, "<u4")
    widths = payload[starts + 4].astype(np.int64)
    counts = _numbers(payload, starts + 5, "<u2").astype(np.int64)
    table = np.zeros((len(starts), block), np.uint32)
    for width in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == width)
        size = -(-block * width // 8)
        weights = 2.0 ** np.arange(width)  # whole numbers below 2**32 are exact as doubles
        for part in np.array_split(rows, -(-len(rows) // 512)):
            packed = payload[starts[part][:, None] + 7 + np.arange(size)]
            flags = np.unpackbits(packed, axis=1, count=block * width, bitorder="little")
            table[part] = flags.reshape(len(part), block, width) @ weights
    at = starts + 7 + -(-block * widths // 8)
    row = np.repeat(np.arange(len(starts)), counts)
    rank = ragged(np.zeros(len(starts), np.int64), counts)
    position = _numbers(payload, at[row] + 2 * rank, "<u2")
    table[row, position] = _numbers(payload, at[row] + 2 * counts[row] + 4 * rank, "<u4")
    return table + low[:, None]


def encode_segment(part: int, number: int, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment without its closing line feed."""
    payload, starts = encode_blocks(ids)
    documents, blocks = len(doc_ids), len(starts)
    size = _HEAD + 13 * documents + 4 * blocks + len(payload) + 1
    head = [MAGIC, size, part, number, documents, len(ids), blocks, BLOCK, len(payload)]
    return b"".join(
        [
            np.array(head, "<u4").tobytes(),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is not None for x in doc_ids], np.uint8).tobytes(),
            sizes.astype("<u4").tobytes(),
            starts.astype("<u4").tobytes(),
            payload.tobytes(),
        ]
    )


class Segment:
    """One segment of a file's bytes, decoded as far as it is asked for."""

    def __init__(self, data: np.ndarray, at: int):
        head = data[at : at + _HEAD].view("<u4").tolist()
        magic, self.size, self.part, self.number, documents, self.tokens, blocks, self.block, payload = head
        if magic != MAGIC or data[at + self.size - 1] != 10:
            raise ValueError("not a segment of token blocks")
        at += _HEAD
        ids, known = data[at : at + 8 * documents].view("<i8"), data[at + 8 * documents : at + 9 * documents]
        self.doc_ids = [x if k else None for x, k in zip(ids.tolist(), known.tolist())]
        at += 9 * documents
        self.sizes = data[at : at + 4 * documents].view("<u4").astype(np.int64)
        at += 4 * documents
        self.starts = data[at : at + 4 * blocks].view("<u4").astype(np.int64)
        at += 4 * blocks
        self.payload = data[at : at + payload]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Token ids from ``start`` to before ``stop``; only their blocks are decoded."""
        stop = self.tokens if stop is None else min(stop, self.tokens)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        values = decode_blocks(self.payload, self.starts[first:last], self.block).ravel()
        return values[start - first * self.block : stop - first * self.block]


def segments(data: bytes) -> Iterator[Segment]:
    """All segments of a file."""
    whole, at = np.frombuffer(data, np.uint8), 0
    while at < len(whole):
        segment = Segment(whole, at)
        yield segment
        at += segment.size


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Write the ids of all documents (``doc_id``, ``text``) to ``folder``, in ascending order of doc_id.

    Rows are dealt by ranges of doc_id, ties by the text's checksum and the row's
    place, so neither a hot id nor copies meet in one task. Files hold a bounded
    number of segments. Null ids come first; null texts are empty; each repeated row
    is written; an empty table gives files without segments.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer).encode
        doc_ids, sizes, parts, tokens = [], [], [], 0

        def segment() -> pa.RecordBatch:
            data = encode_segment(part, number, doc_ids, np.array(sizes, np.int64), np.concatenate(parts))
            return pa.RecordBatch.from_pydict({"segment": pa.array([data], pa.binary())})

        for batch in batches_by_bytes(batches, "text", 1 << 19):
            ids, bounds = with_end(*encode(batch.column("text")), end_id)
            doc_ids += batch.column("doc_id").to_pylist()
            sizes += np.diff(bounds).tolist()
            parts.append(ids)
            tokens += len(ids)
            if tokens >= segment_tokens:
                yield segment()
                doc_ids, sizes, parts, tokens, number = [], [], [], 0, number + 1
        if parts:
            yield segment()

    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        F.col("text").cast("string"),
        F.crc32(F.col("text").cast("string")).alias("tie"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = [F.col("doc_id").asc_nulls_first(), "tie", "place"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    # Casting to string changes no byte; the writer puts them down as they are.
    (
        spread.mapInArrow(run, "segment binary")
        .select(F.col("segment").cast("string"))
        .write.option("maxRecordsPerFile", SEGMENTS_PER_FILE)
        .text(folder)
    )


TOKENS = "doc_id bigint, part int, number int, at int, n_tokens bigint, before bigint, ids binary"


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document of the files, with its ids as unsigned 32-bit integers.

    ``part`` and ``number`` are those of the segment, ``at`` the document's place in
    it and ``before`` the tokens that precede it there.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for x in segments(content.as_buffer()):
                    raw, n = x.ids().astype("<u4").tobytes(), len(x.doc_ids)
                    ends = np.cumsum(x.sizes)
                    offsets = pa.py_buffer((np.append(0, ends) * 4).astype(np.int32).tobytes())
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(x.doc_ids, pa.int64()),
                            "part": pa.array(np.full(n, x.part, np.int32)),
                            "number": pa.array(np.full(n, x.number, np.int32)),
                            "at": pa.array(np.arange(n, dtype=np.int32)),
                            "n_tokens": pa.array(x.sizes),
                            "before": pa.array(ends - x.sizes),
                            "ids": pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(raw)]),
                        }
                    )

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, TOKENS)


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents to files, read them back, and digest what each document's ids are.

    Only one total for each segment is added up in order, never one for each row.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "tokens")
    write_token_files(docs, tokenizer, folder, end_id)
    rows = settle(read_token_files(spark, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    totals = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("tokens"))
    parts = totals.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    starts = totals.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(bases, "part")
    starts = starts.select("part", "number", (F.col("base") + F.col("inside")).alias("first"))
    return rows.join(starts, ["part", "number"]).select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
