"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n``, the work of attention
inside its document. Pieces are placed in descending length, each in the sequence of
lowest cost so far that has room for it. Every task packs windows of bounded size
from the rows that it reads, so nothing is shuffled and no source, long document or
group of copies meets in one task; what a window leaves over opens the next one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgauge.llm.bytewise import batches_by_bytes
from airgauge.llm.tokens import encoder, with_end

CAPACITY = 4096
END_ID = 2
WINDOW_TOKENS = 4 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, sequence_length bigint"
)


def assign(lengths: np.ndarray, sequences: int, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Place items of ``lengths`` (each at most ``capacity``) in ``sequences`` empty sequences.

    Returns (item, start, length, sequence) in the order of placement. An item for
    which no sequence has room is cut over the cheapest sequences with any room; with
    sequence number -1 the rest found none at all. Ties go to the earlier item and
    the lower sequence, so equal input gives equal output.
    """
    room = np.full(sequences, capacity, np.int64)
    cost = np.zeros(sequences)
    placed = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[item])
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
                if not fits.any():
                    placed.append((item, start, left, -1))
                    break
            best = int(np.argmin(np.where(fits, cost, np.inf)))
            length = min(left, int(room[best]))
            placed.append((item, start, length, best))
            room[best] -= length
            cost[best] += linear * length + quadratic * length * length
            start, left = start + length, left - length
    return placed


class _Packer:
    """Packs one task's documents window by window."""

    def __init__(self, task: int, capacity: int):
        self.capacity, self.next_id = capacity, task << 32
        self.items: list[tuple] = []  # (doc_id, start in document, ids, tokens of document)
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.items.append((doc_id, 0, ids, len(ids)))
        self.tokens += len(ids)

    def _rows(self, pieces: list[tuple], sequences: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        """Rows of (doc_id, start, ids, tokens of document) pieces in the given sequences."""
        order = np.argsort(sequences, kind="stable")
        pieces, sequences = [pieces[i] for i in order.tolist()], sequences[order]
        sizes = np.array([len(x[2]) for x in pieces], np.int64)
        before = np.cumsum(sizes) - sizes
        first = np.searchsorted(sequences, sequences)
        columns = {
            "doc_id": pa.array([x[0] for x in pieces], pa.int64()),
            "start": pa.array([x[1] for x in pieces], pa.int64()),
            "length": pa.array(sizes),
            "ids": pa.array([x[2].astype("<u4").tobytes() for x in pieces], pa.binary()),
            "doc_tokens": pa.array([x[3] for x in pieces], pa.int64()),
            "sequence_id": pa.array(sequences + self.next_id),
            "offset": pa.array(before - before[first]),
            "sequence_length": pa.array(lengths[sequences]),
        }
        self.next_id += len(lengths)
        return pa.RecordBatch.from_pydict(columns)

    def _full(self) -> Iterator[pa.RecordBatch]:
        """Whole sequences of one long document each; the items keep what is left of it."""
        pieces, rest = [], []
        for doc_id, start, ids, total in self.items:
            whole = len(ids) - len(ids) % self.capacity
            pieces += [
                (doc_id, start + at, ids[at : at + self.capacity], total) for at in range(0, whole, self.capacity)
            ]
            if whole < len(ids):
                rest.append((doc_id, start + whole, ids[whole:], total))
        self.items = rest
        for low in range(0, len(pieces), 512):
            part = pieces[low : low + 512]
            yield self._rows(part, np.arange(len(part)), np.full(len(part), self.capacity))

    def window(self) -> Iterator[pa.RecordBatch]:
        """Pack all full sequences that the items fill; under ``capacity`` tokens stay."""
        yield from self._full()
        lengths = np.array([len(x[2]) for x in self.items], np.int64)
        count = int(lengths.sum()) // self.capacity
        pieces, sequences, rest = [], [], []
        for item, start, length, sequence in assign(lengths, count, self.capacity):
            doc_id, at, ids, total = self.items[item]
            piece = (doc_id, at + start, ids[start : start + length], total)
            if sequence < 0:
                rest.append(piece)
            else:
                pieces.append(piece)
                sequences.append(sequence)
        self.items, self.tokens = rest, sum(len(x[2]) for x in rest)
        if pieces:
            yield self._rows(pieces, np.array(sequences), np.full(count, self.capacity))

    def end(self) -> Iterator[pa.RecordBatch]:
        """The last tokens go to sequences of falling powers of two, which need no padding."""
        yield from self.window()
        pieces, sequences, lengths, room = [], [], [], 0
        left = self.tokens
        for doc_id, at, ids, total in self.items:
            while len(ids):
                if not room:
                    room = 1 << (left.bit_length() - 1)
                    lengths.append(room)
                size = min(room, len(ids))
                pieces.append((doc_id, at, ids[:size], total))
                sequences.append(len(lengths) - 1)
                at, ids, room, left = at + size, ids[size:], room - size, left - size
        self.items, self.tokens = [], 0
        if pieces:
            yield self._rows(pieces, np.array(sequences), np.array(lengths))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Pieces of all documents (columns ``doc_id``, ``text``) with their place in a sequence.

    ``ids`` holds a piece's token ids as little-endian unsigned 32-bit integers. Each
    document's ids end with ``end_id``. Sequences hold ``capacity`` tokens, a power of
    two; the last ones of a task hold smaller powers of two. Null and empty texts are
    ``end_id`` alone; null ids stay null; repeated rows are packed each; an empty
    table gives no rows; other columns are not looked at.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId(), capacity)
        encode = encoder(tokenizer).encode
        for batch in batches_by_bytes(batches, "text", 1 << 19):
            ids, bounds = with_end(*encode(batch.column("text")), end_id)
            doc_ids = batch.column("doc_id").to_pylist()
            for i, doc_id in enumerate(doc_ids):
                packer.add(doc_id, ids[bounds[i] : bounds[i + 1]])
            if packer.tokens >= window_tokens:
                yield from packer.window()
        yield from packer.end()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, PIECES)
