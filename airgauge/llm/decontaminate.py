"""Benchmark decontamination: each shard of documents gets an FM-index that test phrases are searched in.

A phrase is ten consecutive words of a benchmark item, or a shorter item as a whole.
A shard is a bounded part of what one task reads. Words that no phrase holds are
separators in its index, and runs that are shorter than every phrase are left out, as
no occurrence can lie in them. Occurrences become word spans, which are merged.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgauge.llm.bytewise import ALPHANUMERIC, LOWER, batches_by_bytes, hashes, joined, per_text, ragged, spans
from airgauge.llm.fmindex import FMIndex
from airgauge.session import fresh_folder, settle

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 18  # benchmark words searched for at a time
PASS_BYTES = 128 << 20  # of phrases, broadcast for one pass over the documents

_SPANS = "array<struct<start:bigint,stop:bigint>>"
HITS = f"doc_id bigint, n_words bigint, n_hit bigint, items array<string>, removed {_SPANS}"
#: Documents between two passes, with the hits so far.
_SO_FAR = f"doc_id bigint, text string, items array<string>, spans {_SPANS}"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte (in its text) of all words; first word and first byte of each text."""
    data, text_starts, _ = joined(texts)
    data = LOWER[data]
    starts, ends = spans(data, ALPHANUMERIC)
    return hashes(data, starts, ends), starts, ends, per_text(starts, text_starts), text_starts


@dataclass
class Phrases:
    """The distinct phrases of a block of items."""

    vocabulary: np.ndarray  # sorted word hashes; a word's symbol is its place here, from 1
    patterns: np.ndarray
    lengths: np.ndarray
    items: list[str]
    owners: np.ndarray  # items of each phrase, one phrase after the other
    bounds: np.ndarray

    @classmethod
    def of(cls, ids: list[str], texts: list[str], window: int = WINDOW) -> Phrases:
        words, _, _, first, _ = _words(pa.array(texts, pa.string()))
        vocabulary = np.unique(words)
        symbols = np.searchsorted(vocabulary, words) + 1
        found: dict[tuple, set[int]] = {}
        for i, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            own = symbols[low:high].tolist()
            for at in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[at : at + window]), set()).add(i)
        patterns = np.zeros((len(found), window), np.int32)
        lengths = np.array([len(x) for x in found], np.int64)
        for row, x in zip(patterns, found):
            row[: len(x)] = x
        sizes = [len(x) for x in found.values()]
        owners = np.array([i for x in found.values() for i in sorted(x)], np.int64)
        return cls(vocabulary, patterns, lengths, ids, owners, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))

    def find(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start word, end word, phrase) of all occurrences in a shard whose texts begin at the words ``first``."""
        nothing = np.zeros(0, np.int64)
        if not len(self.lengths) or not len(words):
            return nothing, nothing, nothing
        place = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        symbols = np.where(self.vocabulary[place] == words, place + 1, 0)
        # Runs of known words, ended by an unknown word or the text's end.
        edge = np.zeros(len(words) + 1, bool)
        edge[first] = True
        known = symbols > 0
        begins = known & (edge[:-1] | ~np.concatenate([[False], known[:-1]]))
        ends = known & (edge[1:] | ~np.concatenate([known[1:], [False]]))
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long_enough = end - begin >= self.lengths.min()
        begin, end = begin[long_enough], end[long_enough]
        if not len(begin):
            return nothing, nothing, nothing
        sizes = end - begin + 1  # a separator follows each run
        at = ragged(begin, sizes)
        text = np.zeros(len(at), np.int64)
        inner = np.ones(len(at), bool)
        inner[np.cumsum(sizes) - 1] = False
        text[inner] = symbols[at[inner]]
        phrase, position = FMIndex(text, len(self.vocabulary)).occurrences(self.patterns, self.lengths)
        start = at[position]
        return start, start + self.lengths[phrase], phrase


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])
    return starts[new], ends[last]


def scan(texts: pa.Array, blocks: list, items: list | None = None, spans_: list | None = None) -> list[tuple]:
    """(words, hit words, item ids, removed byte spans, hit word spans) of each text.

    ``blocks`` are broadcast phrases; ``items`` and ``spans_`` are hits of earlier passes.
    """
    words, byte_start, byte_end, first, text_byte = _words(texts)
    count = len(texts)
    names = [set(x) for x in items] if items else [set() for _ in range(count)]
    earlier = [(int(first[i]) + x["start"], int(first[i]) + x["stop"]) for i, own in enumerate(spans_ or ()) for x in own]
    starts, ends = ([np.array([x[k] for x in earlier], np.int64)] for k in (0, 1))
    for block in blocks:
        phrases = block.value
        start, end, phrase = phrases.find(words, first[:-1])
        starts.append(start)
        ends.append(end)
        text = np.searchsorted(first, start, "right") - 1
        pairs = np.unique(text * len(phrases.lengths) + phrase) if len(start) else np.zeros(0, np.int64)
        for pair in pairs.tolist():
            i, p = divmod(pair, len(phrases.lengths))
            owners = phrases.owners[phrases.bounds[p] : phrases.bounds[p + 1]]
            names[i].update(phrases.items[k] for k in owners.tolist())
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    removed: list[list[dict]] = [[] for _ in range(count)]
    inside: list[list[dict]] = [[] for _ in range(count)]
    hit = np.zeros(count, np.int64)
    if len(starts):
        low, high = _merged(starts, ends)
        # Spans of neighbouring texts may touch, and are cut at the text's first word again.
        inner = first[:-1][(first[1:] > first[:-1])]
        cuts = np.unique(np.concatenate([low, inner[(inner > 0)]]))
        owner = np.searchsorted(low, cuts, "right") - 1
        ok = (owner >= 0) & (cuts < high[np.maximum(owner, 0)])
        begin = cuts[ok]
        stop = np.minimum(high[owner[ok]], np.append(cuts[1:], len(words))[ok])
        text = np.searchsorted(first, begin, "right") - 1
        np.add.at(hit, text, stop - begin)
        for i, a, b in zip(text.tolist(), byte_start[begin] - text_byte[text], byte_end[stop - 1] - text_byte[text]):
            removed[i].append({"start": int(a), "stop": int(b)})
        for i, a, b in zip(text.tolist(), begin - first[text], stop - first[text]):
            inside[i].append({"start": int(a), "stop": int(b)})
    return list(zip(np.diff(first).tolist(), hit.tolist(), map(sorted, names), removed, inside))


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(number, block, size): all phrases of ``benchmark`` (item_id, text), packed by tasks in blocks of bounded size.

    An item stays whole, so a block holds one at least. Blocks are written down.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[str] = []
        texts: list[str] = []
        words = 0

        def block() -> pa.RecordBatch:
            raw = pickle.dumps(Phrases.of(ids, texts, window), pickle.HIGHEST_PROTOCOL)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["block"])

        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                ids.append(item)
                texts.append(text)
                words += len(text) // 2 + 1  # no text has more words
                if words >= block_words:
                    yield block()
                    ids, texts, words = [], [], 0
        if texts:
            yield block()

    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    blocks = rows.mapInArrow(run, "block binary").withColumn("number", F.monotonically_increasing_id())
    return settle(blocks.select("number", "block", F.length("block").alias("size")))


def _passes(benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> Iterator[tuple[list, bool]]:
    """Broadcast phrases for each pass over the documents, and whether it is the last.

    The driver holds the phrases of one pass at a time, ``pass_bytes`` or one block of them.
    """
    context = benchmark.sparkSession.sparkContext
    blocks = phrase_blocks(benchmark)
    groups: list[list[int]] = [[]]
    size = 0
    for row in blocks.select("number", "size").orderBy("number").collect():
        if groups[-1] and size + row["size"] > pass_bytes:
            groups.append([])
            size = 0
        groups[-1].append(row.number)
        size += row["size"]
    for place, numbers in enumerate(groups):
        rows = blocks.where(F.col("number").isin(numbers)).select("block").collect() if numbers else []
        yield [context.broadcast(pickle.loads(bytes(r.block))) for r in rows], place == len(groups) - 1


_NAMES = [["doc_id", "n_words", "n_hit", "items", "removed"], ["doc_id", "text", "items", "spans"]]
_LIST = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hits of the benchmark in every document (``doc_id``, ``text``): items and removed byte spans.

    Nothing is shuffled. A benchmark of more than ``PASS_BYTES`` of phrases takes several
    passes over the documents, which carry their hits along. Null and empty texts have no words; items without
    text or id are no phrases; repeated rows are searched each; an empty benchmark hits
    nothing; other columns are ignored.
    """

    def searched(blocks: list, last: bool, so_far: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches_by_bytes(batches, "text", SHARD_WORDS * 4):
                earlier = [batch.column(x).to_pylist() for x in ("items", "spans")] if so_far else []
                words, hits, items, removed, inside = map(list, zip(*scan(batch.column("text"), blocks, *earlier)))
                names = pa.array(items, pa.list_(pa.string()))
                if last:
                    more = [pa.array(words, pa.int64()), pa.array(hits, pa.int64()), names, pa.array(removed, _LIST)]
                else:
                    more = [batch.column("text"), names, pa.array(inside, _LIST)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *more], _NAMES[not last])

        return run

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    so_far = False
    for blocks, last in _passes(benchmark):
        found = rows.mapInArrow(searched(blocks, last, so_far), HITS if last else _SO_FAR)
        rows = found if last else _written(found, blocks)
        so_far = True
    return rows


def _written(rows: DataFrame, blocks: list) -> DataFrame:
    """``rows`` as a table, so that the phrases of their pass can go."""
    folder = fresh_folder(rows.sparkSession, "searched")
    rows.write.parquet(folder)
    for block in blocks:
        block.destroy()
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold any benchmark phrase."""

    def clean(blocks: list):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches_by_bytes(batches, "text", SHARD_WORDS * 4):
                yield batch.filter(pa.array([not hit for _, hit, *_ in scan(batch.column("text"), blocks)]))

        return run

    for blocks, last in _passes(benchmark):
        left = docs.mapInArrow(clean(blocks), docs.schema)
        docs = left if last else _written(left, blocks)
    return docs


def cut(text: str | None, removed: list) -> str | None:
    """``text`` without the removed byte spans."""
    if text is None:
        return None
    raw, at, out = text.encode(), 0, []
    for span in removed:
        out.append(raw[at : span["start"]])
        at = span["stop"]
    return b"".join([*out, raw[at:]]).decode()
