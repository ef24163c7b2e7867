"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training adds up n-gram counts of all labelled documents, task by task; the matrix of
log probabilities (buckets x languages) is broadcast, and texts are scored in batches
by summing the rows of their n-grams.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgauge.llm.bytewise import batches_by_bytes
from airgauge.llm.tables import COUNTERS, collected, counter_rows, summed

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)  # up to 3, for which the spaces around texts are enough
SMOOTHING = 0.5
MATRIX_BYTES = 256 << 20
UNKNOWN = "und"
_SPACE = 32


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000)


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text of each, and the number of letters of each text.

    Texts are lower-cased, everything but letters becomes a space, and two spaces stand
    before and one after each text. An n-gram of spaces only is none, so none runs from
    one text into the next.
    """
    parts = [(x or "").lower() for x in texts.to_pylist()]
    whole = "".join(f"  {x} " for x in parts) + "   "
    codes = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = 2 + np.cumsum(lengths + 3) - (lengths + 3)
    letter = _letters()[codes]
    codes = np.where(letter, codes, _SPACE).astype(np.uint64)
    before = np.concatenate([[0], np.cumsum(letter)])
    letters = before[starts + lengths] - before[starts]
    used = len(codes) - 3
    text = np.repeat(np.arange(len(parts)), lengths + 3)
    buckets, owners = [], []
    key, some = np.zeros(used, np.uint64), np.zeros(used, bool)
    for n in range(max(ORDERS)):
        key = (key + codes[n : n + used] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        some = some | letter[n : n + used]
        if n + 1 in ORDERS:
            at = np.flatnonzero(some)
            buckets.append(((key[at] * np.uint64(0xD6E8FEB86659FD93 + 2 * n)) >> np.uint64(48)).astype(np.int64))
            owners.append(text[at])
    return np.concatenate(buckets) & (BUCKETS - 1), np.concatenate(owners), letters


@dataclass
class Model:
    """Log probabilities by bucket and language, and log priors."""

    languages: list[str]
    matrix: np.ndarray
    prior: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        buckets, owners, letters = ngrams(texts)
        count = len(letters)
        if not self.languages:
            return [UNKNOWN] * count, np.zeros(count)
        scores = np.stack(
            [np.bincount(owners, self.matrix[:, k][buckets], minlength=count) for k in range(len(self.languages))],
            axis=1,
        )
        scores = scores + self.prior
        best = scores.argmax(axis=1)
        shares = np.exp(scores - scores.max(axis=1, keepdims=True))
        score = np.where(letters > 0, 1.0 / shares.sum(axis=1), 0.0)
        names = [self.languages[k] if some else UNKNOWN for k, some in zip(best.tolist(), letters.tolist())]
        return names, score


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows whose ``lang`` is not null; null and letterless texts teach nothing.

    No rows give a model without languages, which calls every text ``und``.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches_by_bytes(batches, "text", 1 << 18):
            buckets, owners, letters = ngrams(batch.column("text"))
            names = batch.column("lang").to_pylist()
            codes = {name: i for i, name in enumerate(dict.fromkeys(names))}
            code = np.array([codes[x] for x in names])
            for name, i in codes.items():
                total = sums.setdefault(name, np.zeros(BUCKETS + 1024, np.int64))
                total[:BUCKETS] += np.bincount(buckets[code[owners] == i], minlength=BUCKETS)
                total[BUCKETS] += int((letters[code == i] > 0).sum())
        for name, total in sums.items():
            yield from counter_rows(name, total, 1024)

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )
    most = MATRIX_BYTES // (4 * BUCKETS)
    names = sorted(r.lang for r in rows.select("lang").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError("too many languages for a broadcast matrix")
    tables = collected(summed(rows.mapInArrow(count, COUNTERS)), BUCKETS + 1024)
    names = [name for name in names if name in tables]
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    table = np.stack([tables[name] for name in names], axis=1).astype(float)
    texts, table = table[BUCKETS], table[:BUCKETS]
    matrix = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * BUCKETS))
    prior = np.log((texts + 1) / (texts.sum() + len(names)))
    return Model(names, np.asfortranarray(matrix, np.float32), prior)


def with_language(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    ``keep`` names the columns to return besides, by default all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [x for x in keep or docs.columns if x not in ("lang_pred", "score")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", 1 << 18):
            names, score = shared.value.predict(batch.column("text"))
            arrays = [*map(batch.column, kept), pa.array(names, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    read = docs.select(*kept, *([] if "text" in kept else ["text"]))
    return read.mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, *added]))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def identify(docs: DataFrame) -> DataFrame:
    """Predicted language of every document, learned from those outside the held-out fold.

    A null id is neither held out nor learned from. Null and letterless texts are
    ``und`` with score 0. Repeated rows are predicted each. Other columns are ignored.
    """
    remainder = fold(F.col("doc_id"), 5)
    model = fit(docs.where(remainder != 0).select("text", "lang"))
    rows = docs.select("doc_id", F.col("text").cast("string"), F.coalesce(remainder == 0, F.lit(False)).alias("held_out"))
    return with_language(rows, model, ["doc_id", "held_out"])


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language is unknown or less likely than ``least``."""
    model = fit(docs.where(fold(F.col("doc_id"), 5) != 0).select("text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", 1 << 18):
            names, score = shared.value.predict(batch.column("text"))
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, score)]))

    return docs.mapInArrow(run, docs.schema)
