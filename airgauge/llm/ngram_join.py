"""Jaccard self-join of documents on word shingles: grouped prefix join, and its components.

Two sets of similarity s share one of the first n - ceil(s * n) + 1 shingles of either in
any common order. The order here puts rare shingles first; how often each is seen comes
from a table of counters of fixed size. Documents of equal sets are one class, and classes
of equal size and prefix one group. Groups that share a prefix shingle meet in its bucket.

First each bucket ties its groups to the one that has the shingle earliest (for each range
of sizes), which needs two pairs at most for each row of the bucket. Pairs that sizes,
positions and signatures do not rule out are verified on whole sets, and their components
are found. Then every bucket is looked at again for pairs whose components still differ,
all of which are expanded into members, filtered alike and verified. So no pair of
different components is left out, and large groups of near copies are never paired out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgauge.llm.bytewise import NOT_SPACE, batches_by_bytes, mixed, ragged, word_hashes
from airgauge.llm.components import connected
from airgauge.llm.tables import COUNTERS, collected, counter_rows, sketch, summed
from airgauge.operators.running import ONE_TASK_ROWS, running_totals
from airgauge.session import broadcast_if_small, fresh_folder, settle

SHINGLE = 3
SIMILARITY = (90, 100)
COUNTER_BITS = 22  # of the table of shingle counters
FILTER_BITS = 20  # of the filter of documents to verify
SIGNATURE = 512  # bits, at least
LARGE = 512  # rows of a bucket that one task compares
_BATCH = 1 << 20


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes(texts, NOT_SPACE)
    sets = []
    bounds = list(zip(first[:-1].tolist(), first[1:].tolist()))
    full = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        full = full * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(full)]
        full = full ^ (full >> np.uint64(31))
    full = mixed(full)
    for low, high in bounds:
        if high - low >= size:
            sets.append(np.unique(full[low : high - size + 1]))
        elif high > low:
            short = np.array([high - low], np.uint64)
            for k in range(low, high):
                short = mixed(short * np.uint64(0xD6E8FEB86659FD93) + words[k : k + 1])
            sets.append(short)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """A class of frequency (a quarter of a power of two) for each bucket of shingle hashes."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches_by_bytes(batches, "text", _BATCH):
            found = np.concatenate([*shingle_sets(batch.column("text"), size), np.zeros(0, np.uint64)])
            counts += np.bincount((found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=1 << COUNTER_BITS)
        yield from counter_rows("", counts, 1 << (COUNTER_BITS - 6))

    counts = collected(summed(docs.select("text").mapInArrow(count, COUNTERS)), 1 << COUNTER_BITS).get("", np.zeros(1 << COUNTER_BITS))
    return np.floor(4 * np.log2(counts + 1.0)).astype(np.uint8)


def _profiles(docs: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """(place, doc_id, n, cls, prefix, sign) of each document; ``cls`` digests its whole set.

    ``sign`` holds, for each part of the hash range, whether an odd number of shingles fall
    in it. Where two signs differ, the sets differ too, once for each bit. The number of
    parts is a power of two and grows with the set, half a bit for each shingle or more,
    so that the signs of long texts tell as much as those of short ones.
    """
    num, den = similarity
    shared = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, size))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", _BATCH):
            sets = shingle_sets(batch.column("text"), size)
            digests, prefixes = [], []
            signs = []
            for found in sets:
                n = len(found)
                if not n:
                    digests.append(None)
                    prefixes.append(None)
                    signs.append(None)
                    continue
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                often = shared.value[(found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)].astype(np.uint64)
                key = (often << np.uint64(56)) | (found >> np.uint64(8))
                length = n - -(-num * n // den) + 1
                prefixes.append(found[np.argsort(key, kind="stable")[:length]].tobytes())
                parts = max(SIGNATURE, 1 << (n // 2).bit_length())
                odd = np.bincount((found & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
                signs.append(np.packbits(odd.astype(np.uint8)).tobytes())
            columns = [
                batch.column("place"),
                batch.column("doc_id"),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(prefixes, pa.binary()),
                pa.array(signs, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["place", "doc_id", "n", "cls", "prefix", "sign"])

    return docs.mapInArrow(run, "place bigint, doc_id bigint, n bigint, cls binary, prefix binary, sign binary")


def _buckets(groups: DataFrame) -> DataFrame:
    """A row (token, pos, n, head) for each prefix shingle of each group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                raw = [x.as_buffer() for x in part.column("prefix")]
                lengths = np.array([x.size // 8 for x in raw], np.int64)
                owner = pa.array(np.repeat(np.arange(len(raw)), lengths))
                tokens = np.frombuffer(b"".join(raw), np.int64)
                columns = [pa.array(tokens), pa.array(ragged(np.zeros(len(raw), np.int64), lengths))]
                columns += [part.column(name).take(owner) for name in ("n", "head")]
                yield pa.RecordBatch.from_arrays(columns, ["token", "pos", "n", "head"])

    return groups.select("prefix", "n", "head").mapInArrow(run, "token bigint, pos bigint, n bigint, head bigint")


def _may_match(n1, pos1, n2, pos2, similarity: tuple[int, int]) -> np.ndarray:
    """Whether sets whose first common shingle stands at these positions can be similar enough."""
    num, den = similarity
    need = -(-num * (n1 + n2) // (num + den))
    return (np.minimum(n1, n2) * den >= num * np.maximum(n1, n2)) & (np.minimum(n1 - pos1, n2 - pos2) >= need)


_SHARED = ("token", "pos", "n", "head", "leader", "former")


def _shared_buckets(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The rows of all buckets that several groups share, with the groups that each is first compared to.

    ``leader`` has the shingle earliest among the bucket's groups of the same range of
    sizes, ``former`` among those of the next smaller one; null where there is none or it
    cannot be similar. Buckets are streamed in order and two leaders are remembered, so a
    bucket of any size fits.
    """
    num, den = similarity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, told = np.zeros((0, 5), np.int64), np.zeros(0, bool)  # the last leaders, and whether given out
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(k).to_numpy() for k in ("token", "pos", "n", "head", "range")], axis=1)
            table = np.concatenate([carried, table])
            token, size_range = table[:, 0], table[:, 4]
            same = np.concatenate([[False], token[1:] == token[:-1]])
            new = ~same
            new[1:] |= size_range[1:] != size_range[:-1]
            begins = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            own, before = begins[run_of], np.concatenate([[0], begins[:-1]])[run_of]
            linked = (token[before] == token) & (size_range[before] == size_range - 1)
            leaders = []
            for leader, ok in ((own, own != np.arange(len(table))), (before, linked)):
                first = table[leader]
                ok = ok & _may_match(first[:, 2], first[:, 1], table[:, 2], table[:, 1], similarity)
                leaders.append(pa.array(first[:, 3], mask=~ok))
            near = same | np.concatenate([same[1:], [False]])
            fresh = near.copy()
            fresh[: len(told)] &= ~told
            columns = [*map(pa.array, table[:, :4].T), *leaders]
            yield pa.RecordBatch.from_arrays(columns, _SHARED).filter(pa.array(fresh))
            kept = [int(before[-1]), int(own[-1])] if linked[-1] else [int(own[-1])]
            carried, told = table[kept], near[kept]

    scale = float(np.log(den / num))
    ranged = rows.withColumn("range", F.floor(F.log(F.col("n").cast("double")) / F.lit(scale)).cast("bigint"))
    dealt = ranged.repartition(F.col("token")).sortWithinPartitions("token", "range", "pos", "n", "head")
    return dealt.mapInArrow(run, ", ".join(f"{name} bigint" for name in _SHARED))


def _differing(one: np.ndarray, i: np.ndarray, two: np.ndarray, j: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Distinct pairs of heads, of rows ``i`` and ``j`` that can be similar and whose ``comp`` differs.

    Tables have the columns token, pos, n, comp and head.
    """
    apart = one[i, 3] != two[j, 3]
    i, j = i[apart], j[apart]
    ok = _may_match(one[i, 2], one[i, 1], two[j, 2], two[j, 1], similarity)
    return np.unique(np.sort(np.stack([one[i[ok], 4], two[j[ok], 4]], axis=1), axis=1), axis=0)


_ROW = ("token", "pos", "n", "comp", "head")


def _table(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy() for k in _ROW], axis=1)


def _cross_pairs(
    buckets: DataFrame,
    labelled: Callable[[DataFrame], DataFrame],
    similarity: tuple[int, int],
    large: int | None = None,
) -> DataFrame:
    """Pairs of a bucket's groups that can be similar and whose ``comp`` differs.

    ``labelled`` gives rows of ``buckets`` their ``comp``. Buckets of up to ``large`` rows are
    compared by the task that has them. Larger ones with several components are cut into
    blocks, and pairs of blocks meet in tasks of their own.
    """
    large = LARGE if large is None else large
    sizes = buckets.groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
    hot = settle(sizes.where(F.col("rows") > large))
    total = hot.agg(F.sum("rows")).first()[0]
    if not total:
        return _small_bucket_pairs(labelled(buckets), similarity).distinct()
    tokens = broadcast_if_small(hot.select("token"))
    small = _small_bucket_pairs(labelled(buckets.join(tokens, "token", "left_anti")), similarity)
    rows = settle(labelled(buckets.join(tokens, "token", "left_semi")))
    several = rows.groupBy("token").agg((F.min("comp") < F.max("comp")).alias("several")).where("several")
    rows = settle(rows.join(broadcast_if_small(settle(several.select("token"))), "token", "left_semi"))
    if rows.isEmpty():
        return small.distinct()
    return small.unionAll(_block_pairs(rows, similarity, large, total > ONE_TASK_ROWS)).distinct()


def _block_pairs(rows: DataFrame, similarity: tuple[int, int], size: int, sliced: bool) -> DataFrame:
    """Pairs of large buckets: those of each row outside the bucket's largest component with all rows.

    Rows are ranked by their size within the bucket and cut into blocks of ``size``;
    only blocks whose sizes can be similar meet.
    """
    num, den = similarity
    counts = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("rows"))
    top = counts.groupBy("token").agg(F.max_by("comp", F.struct("rows", "comp")).alias("top"))
    marked = settle(rows.join(top, "token").withColumn("other", F.col("comp") != F.col("top")).drop("top"))

    def in_blocks(part: DataFrame) -> DataFrame:
        ranked = running_totals(part.withColumn("one", F.lit(1)), ["n", "head"], "one", ["token"], sliced)
        blocked = settle(ranked.withColumn("block", F.expr(f"before div {size}")).select(*_ROW, "block"))
        return blocked.toDF(*blocked.columns)  # columns of its own, for the joins below

    def bounds(blocked: DataFrame, name: str) -> DataFrame:
        ends = blocked.groupBy("token", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
        return ends.withColumnsRenamed({"block": name, "least": f"least_{name}", "most": f"most_{name}"})

    others, every = in_blocks(marked.where("other")), in_blocks(marked)
    near = (F.col("most_a") * den >= F.col("least_b") * num) & (F.col("most_b") * den >= F.col("least_a") * num)
    met = settle(bounds(others, "a").join(bounds(every, "b"), "token").where(near).select("token", "a", "b"))
    met = met.toDF("token", "a", "b")

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        found = [np.zeros((0, 2), np.int64)]
        if one.num_rows and two.num_rows:
            x, y = _table(one), _table(two)
            for low in range(0, len(x), 1 << 10):
                i = np.arange(low, min(low + (1 << 10), len(x)))
                found.append(_differing(x, np.repeat(i, len(y)), y, np.tile(np.arange(len(y)), len(i)), similarity))
        pairs = np.concatenate(found)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    keys = ["token", "a", "b"]
    left = met.join(others.withColumnRenamed("block", "a"), ["token", "a"]).select(*_ROW, "a", "b").toDF(*_ROW, "a", "b")
    right = met.join(every.withColumnRenamed("block", "b"), ["token", "b"]).select(*_ROW, "a", "b").toDF(*_ROW, "a", "b")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "a bigint, b bigint")


def _small_bucket_pairs(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs of buckets that a task can hold one by one."""
    num, den = similarity
    small = 64

    def of_many(table: np.ndarray) -> Iterator[np.ndarray]:
        """All pairs but those inside the largest component: those of each other row with all rows."""
        names, counts = np.unique(table[:, 3], return_counts=True)
        if len(names) < 2:
            return
        table = table[np.argsort(table[:, 2], kind="stable")]
        n = table[:, 2]
        others = np.flatnonzero(table[:, 3] != names[np.argmax(counts)])
        low = np.searchsorted(n, -(-num * n[others] // den), "left")
        sizes = np.searchsorted(n, den * n[others] // num, "right") - low
        yield _differing(table, np.repeat(others, sizes), table, ragged(low, sizes), similarity)

    def of_buckets(table: np.ndarray, begins: np.ndarray) -> Iterator[np.ndarray]:
        sizes = np.diff(np.append(begins, len(table)))
        ends = np.repeat(begins + sizes, sizes)
        at = np.arange(len(table))
        rest = np.where(np.repeat(sizes, sizes) <= small, ends - at - 1, 0)
        yield _differing(table, np.repeat(at, rest), table, ragged(at + 1, rest), similarity)
        for k in np.flatnonzero(sizes > small).tolist():
            yield from of_many(table[begins[k] : begins[k] + sizes[k]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(_ROW)), np.int64)  # a bucket that the next batch may go on with
        for batch in _and_none(batches):
            if batch is not None and not batch.num_rows:
                continue
            table = held if batch is None else np.concatenate([held, _table(batch)])
            if not len(table):
                continue
            begins = np.concatenate([[0], np.flatnonzero(table[1:, 0] != table[:-1, 0]) + 1])
            last = len(table) if batch is None else int(begins[-1])
            held = table[last:]
            if last:
                for found in of_buckets(table[:last], begins[begins < last]):
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    dealt = rows.repartition(F.col("token")).sortWithinPartitions("token")
    return dealt.select(*_ROW).mapInArrow(run, "a bigint, b bigint")


def _and_none(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then a None that tells their end."""
    yield from batches
    yield None


def _close(pairs: DataFrame, classes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) of places whose signs do not show that they differ too much."""
    num, den = similarity
    one = classes.select(F.col("place").alias("a"), F.col("n").alias("n1"), F.col("sign").alias("s1"))
    two = classes.select(F.col("place").alias("b"), F.col("n").alias("n2"), F.col("sign").alias("s2"))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n1").to_numpy() + batch.column("n2").to_numpy()
            differ = np.zeros(len(n), np.int64)
            sizes = np.stack([pc.binary_length(batch.column(s)).to_numpy() for s in ("s1", "s2")], axis=1)
            for shape in np.unique(sizes, axis=0):
                at = np.flatnonzero((sizes == shape).all(axis=1))
                x, y = (_rows_of(batch.column(s).take(pa.array(at)), k) for s, k in zip(("s1", "s2"), shape.tolist()))
                width = int(shape.min())
                differ[at] = np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum(axis=1, dtype=np.int64)
            need = -(-num * n // (num + den))
            yield batch.select(["a", "b"]).filter(pa.array(differ <= n - 2 * need))

    both = pairs.join(one, "a").join(two, "b")
    return both.select("a", "b", "n1", "n2", "s1", "s2").mapInArrow(check, "a bigint, b bigint")


def _rows_of(values: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width as the rows of a table of bytes."""
    return np.frombuffer(b"".join(x.as_buffer() for x in values), np.uint8).reshape(-1, width)


def _folded(signs: np.ndarray, width: int) -> np.ndarray:
    """Signs of fewer parts, which hold whether the parts that fall together are odd in sum."""
    return np.bitwise_xor.reduce(signs.reshape(len(signs), -1, width), axis=1)


def _verified(docs: DataFrame, pairs: DataFrame, size: int, similarity: tuple[int, int]) -> DataFrame:
    """Those of the distinct pairs (a, b) of places whose whole sets are similar enough.

    Only documents that a filter of fixed size lets through hand on their sets; what it
    lets through in excess is dropped by the joins.
    """
    num, den = similarity
    ends = pairs.select(F.explode(F.array("a", "b")).alias("place")).distinct()
    wanted = sketch(ends.select(F.xxhash64("place").alias("key")), "key", FILTER_BITS) > 0
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted, bitorder="little"))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", _BATCH):
            key = batch.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            ask = (shared.value[(key >> np.uint64(3)).astype(np.int64)] >> (key & np.uint64(7)).astype(np.uint8)) & 1
            part = batch.filter(pa.array(ask.astype(bool)))
            if part.num_rows:
                found = pa.array([x.tobytes() for x in shingle_sets(part.column("text"), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("place"), found], ["place", "items"])

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for one, two in zip(batch.column("items"), batch.column("other")):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                together = np.concatenate([x, y])
                together.sort(kind="stable")
                common = int(np.count_nonzero(together[1:] == together[:-1]))
                ok.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    asked = docs.select("place", "text", F.xxhash64("place").alias("key"))
    known = asked.mapInArrow(sets, "place bigint, items binary")
    second = known.withColumnsRenamed({"place": "b", "items": "other"})
    both = pairs.join(second, "b").join(known.withColumnRenamed("place", "a"), "a")
    return both.select("a", "b", "items", "other").mapInArrow(check, "a bigint, b bigint")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs, the smaller place first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(place, doc_id, n_shingles, component_id, head) of every document (``doc_id``, ``text``).

    Documents link when their shingle sets have a Jaccard similarity of at least num / den.
    ``component_id`` is the smallest doc_id that links reach; null ids are passed over, and
    a component of null ids only has none. ``place`` tells rows apart, repeated ones too,
    and ``head`` is the smallest place of the component. Null and empty texts, and texts of
    white space, have no shingles and link with nothing. Other columns are ignored. ``docs``
    must be a stored table, which gives the same rows in the same place each time it is read.
    """
    spark = docs.sparkSession
    docs = docs.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("place")
    )
    profiles = settle(_profiles(docs, shingle, similarity))
    classes = settle(
        profiles.where("n > 0")
        .groupBy("cls")
        .agg(
            F.min("place").alias("place"),
            F.min("doc_id").alias("least"),
            *[F.first(name).alias(name) for name in ("n", "prefix", "sign")],
        )
    )
    groups = settle(classes.groupBy("n", "prefix").agg(F.min("place").alias("head"), F.count("*").alias("members")))
    shared = groups.where("members > 1").select("n", "prefix", "head")
    inner = settle(classes.join(shared, ["n", "prefix"]).select("place", "head"))  # of groups with several members

    folder = fresh_folder(spark, "buckets")
    _shared_buckets(_buckets(groups), similarity).write.parquet(folder)
    buckets = spark.read.parquet(folder)
    stars = buckets.select(F.col("head").alias("a"), F.explode(F.array("leader", "former")).alias("b")).where("b is not null")
    stars = stars.unionAll(inner.where("place <> head").select(F.col("head").alias("a"), F.col("place").alias("b")))
    first = settle(_close(_ordered(stars), classes, similarity))
    labels = settle(connected(_verified(docs, first, shingle, similarity)))

    # The second look: each group with its component or, if its members differ, one of its own.
    members = settle(
        inner.join(labels.withColumnRenamed("node", "place"), "place", "left").select(
            "head", "place", F.coalesce("root", "place").alias("comp")
        )
    )
    mixed_groups = members.groupBy("head").agg((F.min("comp") != F.max("comp")).alias("mixed")).where("mixed")
    own = labels.withColumnRenamed("node", "head").join(mixed_groups, "head", "full")
    comp = F.when(F.col("mixed"), -F.col("head") - 1).otherwise(F.coalesce("root", "head")).alias("comp")

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(own, "head", "left").select("token", "pos", "n", "head", comp)

    crossing = _cross_pairs(buckets.select("token", "pos", "n", "head"), labelled, similarity)
    one = members.select(F.col("head").alias("a"), F.col("place").alias("a1"), F.col("comp").alias("c1"))
    two = members.select(F.col("head").alias("b"), F.col("place").alias("b1"), F.col("comp").alias("c2"))
    expanded = (
        crossing.join(one, "a", "left")
        .join(two, "b", "left")
        .where(F.col("c1").isNull() | F.col("c2").isNull() | (F.col("c1") != F.col("c2")))
        .select(F.coalesce("a1", "a").alias("a"), F.coalesce("b1", "b").alias("b"))
    )
    within = one.join(two, F.col("a") == F.col("b")).where((F.col("a1") < F.col("b1")) & (F.col("c1") != F.col("c2")))
    rest = _ordered(expanded.unionAll(within.select(F.col("a1").alias("a"), F.col("b1").alias("b"))))
    rest = settle(_close(rest, classes, similarity))
    if not rest.isEmpty():
        more = _verified(docs, rest, shingle, similarity)
        labels = settle(connected(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)))

    rooted = classes.join(labels.withColumnRenamed("node", "place"), "place", "left").select(
        "cls", "least", F.coalesce("root", "place").alias("head")
    )
    least = rooted.groupBy("head").agg(F.min("least").alias("component_id"))
    ends = rooted.select("cls", "head").join(least, "head")
    return (
        profiles.select("place", "doc_id", "n", "cls")
        .join(ends, "cls", "left")
        .select(
            "place",
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.coalesce("head", "place").alias("head"),
        )
    )


def keep_one(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one document of each component: the one of smallest doc_id, then of smallest place."""
    found = linked_documents(docs, shingle, similarity)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "place")
    row = "_place"
    while row in docs.columns:
        row += "_"
    kept = found.groupBy("head").agg(F.min(order).alias("best")).select(F.col("best.place").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").drop(row)
