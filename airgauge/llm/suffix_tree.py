"""Language-model scores by a probabilistic suffix tree over words.

A context of one to ``DEPTH`` words is a candidate if the training texts hold it
``LEAST_COUNT`` times, and so are the next words that follow it as often: absolute
numbers, so whatever a small corpus keeps a larger one keeps as well. A context stays in the
tree if the distribution of what follows it diverges from that of its longest proper
suffix, or if a longer context that stays needs it. A state's distribution hands the mass
of all but its kept next words to the state of the next shorter suffix, down to add-one word
frequencies. A token is scored by the longest suffix before it that is a state.

Documents are cut into chunks, which are stored once, bucketed, as token numbers. Level by
level a chunk asks for the counts of its n-grams, of which only those can matter whose
shorter parts are frequent. Questions are sorted keys, dealt by ranges of the key space;
an answer is one number for each key in the order asked, so it needs no keys. Frequent n-grams
get a short number by which they go from there. A hot n-gram is one key of each chunk. The
tree is a table; no task and no broadcast holds it.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgauge.llm.bytewise import NOT_SPACE, batches_by_bytes, mixed, word_hashes
from airgauge.session import fresh_folder

DEPTH = 3
LEAST_COUNT = 4
DIVERGENCE = 0.01  # nats
PRIOR = 20.0  # tokens that a state leaves to the shorter suffix, besides its rare next words
END = 0  # stands for a text's end among the word hashes
CHUNK_BYTES = 4 << 20  # of text; a longer text is a chunk of its own
_CHUNKS_PER_BLOCK = 4  # whose keys one task adds up, about
_MOST_BUCKETS = 100_000
_BATCH = 1 << 20
_KEY_BITS = np.uint64(0xFFFFFFFFFFFFFF00)  # n-grams have keys of 56 bits, at the top


# ---------------------------------------------------------------- numbers as bytes


def _pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    count = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * count, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64)


def _distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and which value stands at each place."""
    count = len(numbers)
    if not count:
        nothing = np.zeros(0, np.int32)
        return numbers, nothing, nothing
    width = count.bit_length()
    if int(numbers.max()).bit_length() + width <= 64:  # value and place fit one number, which sorts fast
        packed = (numbers.astype(np.uint64) << np.uint64(width)) | np.arange(count, dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << width) - 1)).astype(np.int32)
        packed >>= np.uint64(width)
        ordered = packed.view(numbers.dtype)
    else:
        order = np.argsort(numbers).astype(np.int32)
        ordered = numbers[order]
    new = np.ones(count, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(count, np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new], which


# ---------------------------------------------------------------- chunks


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and where each text's tokens begin."""
    words, first = word_hashes(texts, NOT_SPACE)
    return np.insert(words, first[1:], np.uint64(END)), first + np.arange(len(first))


@dataclass
class Answer:
    """What a chunk was told about the keys of a level, in the order asked."""

    totals: np.ndarray
    names: np.ndarray  # of the frequent ones; 0 for the others
    first: np.ndarray

    @classmethod
    def none(cls) -> Answer:
        return cls(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))


@dataclass
class Level:
    """N-grams of one length in a chunk: contexts of ``k`` words with their next words."""

    at: np.ndarray  # tokens that are next words
    row: np.ndarray  # key of each of them
    keys: np.ndarray  # sorted, distinct
    counts: np.ndarray  # in the chunk's training texts
    context: np.ndarray  # of each key, among the contexts
    word: np.ndarray  # next word of each key
    some: np.ndarray  # a token of each key
    state: np.ndarray  # context before each token, -1 for none
    contexts: Answer  # about the contexts, sorted by their keys
    answer: Answer | None = None  # about the keys

    def seen(self) -> np.ndarray:
        """The contexts that stand before some token, in the order of their keys."""
        some = np.zeros(len(self.contexts.totals), bool)
        some[self.state[self.state >= 0]] = True
        return np.flatnonzero(some)


class Chunk:
    """Tokens of some documents, as numbers of the chunk's own words."""

    def __init__(self, doc_id: pa.Array, held_out: pa.Array, learned: np.ndarray, tokens: np.ndarray, first: np.ndarray):
        self.doc_id, self.held_out, self.first, self._learned = doc_id, held_out, first, learned
        self.vocabulary, ids = np.unique(tokens, return_inverse=True)
        self.ids = ids.astype(np.int32)

    def __getstate__(self):
        return {**self.__dict__, "vocabulary": _pack_sorted(self.vocabulary), "ids": _pack(self.ids)}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.vocabulary, self.ids = _unpack_sorted(state["vocabulary"]), _unpack(state["ids"]).astype(np.int32)

    def dumps(self) -> bytes:
        raw = pickle.dumps(self, pickle.HIGHEST_PROTOCOL)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @staticmethod
    def loads(raw: bytes) -> Chunk:
        return pickle.loads(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd"))

    @property
    def learned(self) -> np.ndarray:
        """1 for each token of a training text."""
        return np.repeat(self._learned, np.diff(self.first)).astype(np.float64)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.ids, self.learned, minlength=len(self.vocabulary)).astype(np.int64)

    def levels(self, answers: list[Answer], least: int, depth: int) -> Iterator[Level]:
        """The levels whose shorter n-grams are counted: ``answers`` are about words, then each level's keys."""
        ids, size, learned = self.ids, len(self.vocabulary), self.learned
        inner = self.vocabulary[ids] != END  # no context runs over a text's end
        frequent = answers[0].totals[ids] >= least
        state = np.where(frequent & inner, ids, -1).astype(np.int32)
        context_keys = self.vocabulary
        for k in range(1, depth + 1):
            before = np.concatenate([np.array([-1], np.int32), state[:-1]])
            at = np.flatnonzero((before >= 0) & frequent).astype(np.int32)
            pairs, first, inverse = _distinct(before[at].astype(np.int64) * size + ids[at])
            context, word = (pairs // size).astype(np.int32), (pairs % size).astype(np.int32)
            hashed = mixed(context_keys[context] * np.uint64(0x9E3779B97F4A7C15) + self.vocabulary[word]) & _KEY_BITS
            keys, where, same = _distinct(hashed)
            row = same[inverse]
            counts = np.bincount(row, learned[at], minlength=len(keys)).astype(np.int64)
            level = Level(at, row, keys, counts, context[where], word[where], at[first[where]], before, answers[k - 1])
            if k == len(answers):
                yield level
                return
            level.answer = answers[k]
            yield level
            good = level.answer.totals[row] >= least
            frequent = np.zeros(len(ids), bool)
            frequent[at[good]] = True
            state = np.full(len(ids), -1, np.int32)
            ends = good & inner[at]
            state[at[ends]] = row[ends]
            context_keys = keys


_CHUNKS = "chunk bigint, state binary"


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
    size = 0

    def row() -> pa.RecordBatch:
        whole = pa.Table.from_batches([x for x, _, _ in held])
        starts = np.cumsum([0, *(len(w) for _, w, _ in held)])
        first = np.concatenate([*(f[:-1] + s for (_, _, f), s in zip(held, starts)), starts[-1:]])
        chunk = Chunk(
            whole["doc_id"].combine_chunks(),
            whole["held_out"].combine_chunks(),
            whole["learned"].to_numpy(),
            np.concatenate([w for _, w, _ in held]),
            first,
        )
        columns = [pa.array([task << 32 | number], pa.int64()), pa.array([chunk.dumps()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "state"])

    for batch in batches_by_bytes(batches, "text", _BATCH):
        words, first = _tokens(batch.column("text"))
        held.append((batch.select(["doc_id", "held_out", "learned"]), words, first))
        size += batch.column("text").nbytes
        if size >= CHUNK_BYTES:
            yield row()
            held, size, number = [], 0, number + 1
    if held:
        yield row()


# ---------------------------------------------------------------- questions and answers

_ASKED = "level int, block int, chunk bigint, keys binary, counts binary"
_ANSWERS = (
    "level int, block int, chunk bigint, totals binary, names binary, first binary, kinds bigint, tokens bigint"
)


def _questions(level: int, chunk: int, keys: np.ndarray, counts: np.ndarray | None, shift: int) -> Iterator[pa.RecordBatch]:
    """A chunk's sorted keys, one row for each block (their bits from ``shift`` on) that has any."""
    block = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(keys)] if len(keys) else []
    rows = []
    for low, high in zip(cuts[:-1], cuts[1:]):
        n = None if counts is None else _pack(counts[low:high])
        rows.append((level, int(block[low]), chunk, _pack_sorted(keys[low:high]), n))
    names = [x.split()[0] for x in _ASKED.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    columns = [pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
    yield pa.RecordBatch.from_arrays(columns, names)


def _counted(asked: pa.Table, least: int) -> pa.Table:
    """Totals of all keys of a block, given back to each chunk in the order it asked.

    Keys of ``least`` or more also get a name, the block and their place among these, and one
    chunk that has the key, called its first, is told so. ``kinds`` and ``tokens`` of the block are on its
    first row.
    """
    asked = asked.sort_by("chunk")
    lists = [_unpack_sorted(x) for x in asked["keys"].to_pylist()]
    counts = np.concatenate([_unpack(x) for x in asked["counts"].to_pylist()])
    keys, where, inverse = _distinct(np.concatenate(lists))
    totals = np.bincount(inverse, counts, minlength=len(keys)).astype(np.int64)
    frequent = totals >= least
    names = (np.cumsum(frequent) - 1).astype(np.uint64) | np.uint64(asked["block"][0].as_py() << 32)
    first = np.zeros(len(inverse), bool)
    first[where] = True
    ends = np.cumsum([len(x) for x in lists])
    zeros = [0] * (len(lists) - 1)
    parts = np.split(inverse, ends[:-1])
    return pa.table(
        {
            "level": asked["level"],
            "block": asked["block"],
            "chunk": asked["chunk"],
            "totals": pa.array([_pack(totals[x]) for x in parts], pa.binary()),
            "names": pa.array([_pack_sorted(names[x[frequent[x]]]) for x in parts], pa.binary()),
            "first": pa.array([np.packbits(x).tobytes() for x in np.split(first, ends[:-1])], pa.binary()),
            "kinds": pa.array([int((totals > 0).sum()), *zeros], pa.int64()),
            "tokens": pa.array([int(totals.sum()), *zeros], pa.int64()),
        }
    )


def _looked_up(asked: pa.Table, held: pa.Table) -> pa.Table:
    """Mass of the asked contexts of a block that are states, 0 for the others."""
    names = held["context"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    names, mass = names[order], held["mass"].to_numpy()[order]
    answers = []
    for raw in asked["keys"].to_pylist():
        keys = _unpack_sorted(raw)
        found = np.zeros(len(keys), np.int64)
        if len(names):
            place = np.minimum(np.searchsorted(names, keys), len(names) - 1)
            found = np.where(names[place] == keys, mass[place], 0)
        answers.append(_pack(found))
    columns = {x: asked[x] for x in ("level", "block", "chunk")}
    nothing = {x: pa.nulls(len(answers), k) for x, k in (("names", pa.binary()), ("first", pa.binary()), ("kinds", pa.int64()), ("tokens", pa.int64()))}
    return pa.table({**columns, "totals": pa.array(answers, pa.binary()), **nothing})


def _answers(rows: pa.Table, least: int) -> tuple[list[Answer], list[np.ndarray]]:
    """Answers about words and the levels, and masses of contexts (levels below zero)."""
    rows = rows.sort_by([("level", "ascending"), ("block", "ascending")])
    parts: dict[int, list] = {}
    for level, raw, own, flags in zip(*(rows[x].to_pylist() for x in ("level", "totals", "names", "first"))):
        totals = _unpack(raw).astype(np.int64)
        if level < 0:
            parts.setdefault(level, []).append(totals)
            continue
        names = np.zeros(len(totals), np.uint64)
        names[totals >= least] = _unpack_sorted(own)
        first = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(totals)).astype(bool)
        parts.setdefault(level, []).append((totals, names, first))
    answers = [Answer(*map(np.concatenate, zip(*parts[k]))) for k in range(max(parts, default=-1) + 1)]
    masses = [np.concatenate(parts[-k]) for k in range(1, 1 - min(parts, default=0))]
    return answers, masses


# ---------------------------------------------------------------- the tree

_NOTES = (
    "level int, context bigint, key bigint, parent bigint, n bigint, c bigint, root bigint, "
    "block int, chunk bigint, keys binary"
)


def _notes(chunk: Chunk, number: int, answers: list[Answer], least: int, depth: int) -> Iterator[pa.RecordBatch]:
    """N-grams of the tree that this chunk is the first to hold, and questions for the masses of its contexts."""
    names = [x.split()[0] for x in _NOTES.split(", ")]
    lower: Level | None = None
    lower_row = None
    for k, level in enumerate(chunk.levels(answers, least, depth), 1):
        own = np.flatnonzero((level.answer.totals >= least) & level.answer.first)
        word, context = level.word[own], level.context[own]
        parent = answers[0].names[word] if lower is None else lower.answer.names[lower_row[level.some[own]]]
        columns = [
            np.full(len(own), k, np.int32),
            level.contexts.names[context].view(np.int64),
            level.answer.names[own].view(np.int64),
            parent.view(np.int64),
            level.answer.totals[own],
            level.contexts.totals[context],
            answers[0].totals[word] if lower is None else np.zeros(len(own), np.int64),
        ]
        nothing = [pa.nulls(len(own), x) for x in (pa.int32(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *nothing], names)

        for batch in _questions(-k, number, level.contexts.names[level.seen()], None, 32):
            columns = [pa.nulls(batch.num_rows, pa.int64())] * 6
            asked = [batch.column(x) for x in ("block", "chunk", "keys")]
            yield pa.RecordBatch.from_arrays([batch.column("level"), *columns, *asked], names)
        lower, lower_row = level, np.full(len(chunk.ids), -1, np.int32)
        lower_row[level.at] = level.row


def states(notes: DataFrame, tokens: int, kinds: int, depth: int, divergence: float, written) -> DataFrame:
    """(level, context, mass) of the contexts that stay in the tree.

    ``notes`` has each n-gram once: its name ``key``, its ``context``, the ``parent`` without the oldest word (for
    n-grams of two words the next word itself), the counts ``n`` and ``c`` of n-gram and context, and on level 1 that
    of the next word, ``root``. ``written`` stores what a name is given to.
    """
    shorter, found = None, []
    for k in range(1, depth + 1):
        rows = notes.where(F.col("level") == k)
        if shorter is None:
            rows = rows.withColumn("base", (F.col("root") + 1) / F.lit(float(tokens + kinds + 1)))
        else:
            rows = rows.select("context", "key", "parent", "n", "c").join(shorter, "parent").drop("parent")
            rows = written(rows, f"n-grams-{k}") if k < depth else rows
        # A context may have very many next words: their sums combine before the shuffle.
        share = F.col("n") / F.col("c")
        sums = rows.groupBy("context", "c").agg(
            F.sum("n").alias("mass"),
            F.sum(share * F.log(share / F.col("base"))).alias("gain"),
            F.sum("base").alias("expected"),
        )
        left, other = 1 - F.col("mass") / F.col("c"), 1 - F.col("expected")
        tiny = F.lit(1e-12)
        rest = F.when(left > tiny, left * F.log(left / F.greatest(other, tiny))).otherwise(0.0)
        apart = (F.col("gain") + rest >= divergence).alias("apart")
        found.append(written(sums.select("context", "mass", apart), f"contexts-{k}"))
        if k < depth:
            weight = F.col("c") + F.lit(PRIOR)
            p = F.col("n") / weight + (1 - F.col("mass") / weight) * F.col("base")
            scored = rows.select("context", "key", "n", "c", "base").join(found[-1].select("context", "mass"), "context")
            shorter = written(scored.select(F.col("key").alias("parent"), p.alias("base")), f"level-{k}")
    kept: list[DataFrame] = []
    for k in range(depth, 0, -1):
        rows = found[k - 1]
        if kept:
            # Suffixes of longer states stay: a context of k + 1 words is an n-gram of level k, and its parent the suffix.
            longer = kept[-1].select(F.col("context").alias("key"))
            needed = notes.where(F.col("level") == k).select("key", "parent").join(longer, "key")
            needed = needed.select(F.col("parent").alias("context")).distinct().withColumn("needed", F.lit(True))
            rows = rows.join(needed, "context", "left").withColumn("apart", F.col("apart") | F.col("needed").isNotNull())
        states_ = rows.where("apart").select(F.lit(k).alias("level"), "context", "mass")
        kept.append(written(states_, f"states-{k}"))
    union = kept[0]
    for rows in kept[1:]:
        union = union.unionByName(rows)
    return union


# ---------------------------------------------------------------- scores

SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def _scores(chunk: Chunk, answers: list[Answer], masses: list, tokens: int, kinds: int, least: int, depth: int) -> pa.Table:
    counts = answers[0].totals[chunk.ids]
    p = (counts + 1.0) / (tokens + kinds + 1.0)
    base = np.log10(p)
    for level, mass in zip(chunk.levels(answers, least, depth), masses):
        masses_of = np.zeros(len(level.contexts.totals), np.int64)
        masses_of[level.seen()] = mass
        at = np.flatnonzero(level.state >= 0)
        at = at[masses_of[level.state[at]] > 0]
        context = level.state[at]
        held = masses_of[context]
        seen = np.zeros(len(chunk.ids), np.int64)
        totals = level.answer.totals
        seen[level.at] = np.where(totals >= least, totals, 0)[level.row]
        weight = level.contexts.totals[context] + PRIOR
        p[at] = seen[at] / weight + (1 - held / weight) * p[at]
    begin = chunk.first[:-1]
    columns = [
        chunk.doc_id,
        chunk.held_out,
        pa.array(np.diff(chunk.first)),
        pa.array(np.add.reduceat((counts > 0).astype(np.int64), begin)),
        pa.array(np.full(len(begin), tokens, np.int64)),
        pa.array(np.add.reduceat(base, begin)),
        pa.array(np.add.reduceat(np.log10(p), begin)),
    ]
    return pa.table(dict(zip((x.split()[0] for x in SCORES.split(", ")), columns)))


class _Store:
    """Chunks and what they are told, as bucketed tables, so that each chunk finds its answers
    without moving either again."""

    def __init__(self, spark: SparkSession, rows: DataFrame):
        self.spark = spark
        name = uuid.uuid4().hex
        self.chunks, self.answers = f"airgauge_chunks_{name}", f"airgauge_answers_{name}"
        self._folder = fresh_folder(spark, "answers")
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = min(_MOST_BUCKETS, max(parts, -(-size // CHUNK_BYTES)))
        writer = rows.mapInArrow(_chunks, _CHUNKS).write.bucketBy(self.buckets, "chunk")
        writer.option("path", fresh_folder(spark, "chunks")).option("compression", "none").saveAsTable(self.chunks)
        self.table = spark.table(self.chunks)
        self.bits = max(0, (-(-self.table.count() // _CHUNKS_PER_BLOCK) - 1).bit_length())

    def tell(self, answers: DataFrame) -> None:
        """Add answers to the table of them."""
        dealt = answers.repartition(self.buckets, "chunk")  # as the buckets are, so each is one file
        writer = dealt.write.mode("append").bucketBy(self.buckets, "chunk").option("path", self._folder)
        writer.option("compression", "none").saveAsTable(self.answers)

    def told(self) -> DataFrame:
        return self.spark.table(self.answers)

    def each(self, function, schema: str, least: int) -> DataFrame:
        """``function`` of each chunk and its answers."""

        def run(chunk: pa.Table, held: pa.Table) -> pa.Table:
            if not chunk.num_rows:
                return pa.table({})
            state = Chunk.loads(chunk["state"][0].as_py())
            return function(state, chunk["chunk"][0].as_py(), *_answers(held, least))

        return self.table.groupBy("chunk").cogroup(self.told().groupBy("chunk")).applyInArrow(run, schema)

    def drop(self) -> None:
        for name in (self.chunks, self.answers):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def suffix_scores(
    docs: DataFrame,
    folds: int = 7,
    held: int = 2,
    depth: int = DEPTH,
    least: int = LEAST_COUNT,
    divergence: float = DIVERGENCE,
) -> DataFrame:
    """Base and tree scores (log10) of every document (``doc_id``, ``text``).

    The model learns from documents whose crc32 of the id is not ``held`` modulo
    ``folds``; null ids are neither learned from nor held out. Contexts, and their next
    words, need ``least`` occurrences in these, however many documents there are, and
    contexts a divergence of ``divergence`` nats. Null texts are empty and have their end as only
    token. Repeated rows are learned from and scored each. Other columns are ignored. A text is
    scored whole, by one task.
    """
    spark = docs.sparkSession
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        F.col("text").cast("string"),
        F.coalesce(remainder != held, F.lit(False)).alias("learned"),
        F.coalesce(remainder == held, F.lit(False)).alias("held_out"),
    )
    store = _Store(spark, rows)
    shift = 64 - store.bits

    def written(df: DataFrame, label: str) -> DataFrame:
        folder = fresh_folder(spark, label)
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(*(batch.column(x).to_pylist() for x in ("chunk", "state"))):
                chunk = Chunk.loads(raw)
                yield from _questions(0, number, chunk.vocabulary, chunk.word_counts(), shift)

    def counted(asked: DataFrame) -> DataFrame:
        return asked.groupBy("block").applyInArrow(lambda x: _counted(x, least), _ANSWERS)

    store.tell(counted(store.table.mapInArrow(words, _ASKED)))
    seen = store.told().agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    tokens, kinds = int(seen[0]), int(seen[1])

    def ask(chunk: Chunk, number: int, told: list[Answer], masses: list) -> pa.Table:
        *_, level = chunk.levels(told, least, depth)
        return pa.Table.from_batches(_questions(len(told), number, level.keys, level.counts, shift))

    for _ in range(depth):
        store.tell(counted(store.each(ask, _ASKED, least)))

    def all_levels(told: list[Answer]) -> list[Answer]:
        """A chunk without n-grams of some length asked nothing there."""
        return [*told, *[Answer.none()] * (depth + 1 - len(told))]

    def note(chunk: Chunk, number: int, told: list[Answer], masses: list) -> pa.Table:
        return pa.Table.from_batches(list(_notes(chunk, number, all_levels(told), least, depth)))

    notes = written(store.each(note, _NOTES, least), "notes")
    tree = states(notes.where("key IS NOT NULL"), tokens, kinds, depth, divergence, written)
    block = F.shiftright("context", 32).cast("int").alias("block")
    tree = tree.select((-F.col("level")).alias("level"), block, "context", "mass")
    asked = notes.where("key IS NULL").select("level", "block", "chunk", "keys")
    found = asked.groupBy("level", "block").cogroup(tree.groupBy("level", "block")).applyInArrow(
        lambda a, t: _looked_up(a, t) if a.num_rows else pa.table({}), _ANSWERS
    )
    store.tell(found)

    def score(chunk: Chunk, number: int, told: list[Answer], masses: list) -> pa.Table:
        masses = [*masses, *[np.zeros(0, np.int64)] * (depth - len(masses))]
        return _scores(chunk, all_levels(told), masses, tokens, kinds, least, depth)

    scores = written(store.each(score, SCORES, least), "scores")
    store.drop()
    return scores
