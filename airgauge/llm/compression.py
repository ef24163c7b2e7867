"""Quality scores by compression: texts that a dictionary of good texts shortens best are good.

Two Zstandard dictionaries are built, one from pieces of good and one from pieces of bad
labelled texts. Every text is cut into pieces, each piece is compressed alone with either
dictionary, and the difference of the sizes, over the text's own size, is its feature. A logistic
curve fitted on other labelled texts turns it into the probability that the label is 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgauge.llm.bytewise import batches_by_bytes

# Bounds of what is learned from, for each of the two labels.
DICTIONARY_TEXTS = 3000
PIECES_PER_TEXT = 8
CURVE_TEXTS = 3000

DICTIONARY_BYTES = 64 << 10
PIECE = 768  # bytes compressed at a time
LEVEL = 3
THRESHOLD = 0.3
_RIDGE = 1e-3


@dataclass
class Model:
    """Dictionaries of bad and good texts, and the curve of the difference."""

    bad: bytes
    good: bytes
    slope: float = 0.0
    offset: float = 0.0
    scale: float = 1.0
    _compressors: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_compressors": []}

    def _sizes(self, text: bytes) -> tuple[int, int]:
        if not self._compressors:
            self._compressors.extend(_compressor(x) for x in (self.bad, self.good))
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        bad, good = (sum(len(c.compress(x)) for x in pieces) for c in self._compressors)
        return bad, good

    def differences(self, texts: pa.Array) -> np.ndarray:
        """How many bytes the good dictionary saves against the bad one, for each byte of a text."""
        out = np.zeros(len(texts))
        for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
            if text:
                bad, good = self._sizes(text)
                out[i] = (bad - good) / len(text)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _logistic(self.slope * self.differences(texts) / self.scale + self.offset)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if known:
        known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def dictionary(pieces: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most ``size`` bytes; too few pieces to train one become its content as they are."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def curve(difference: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """(slope, offset, scale) of the logistic curve of best likelihood; without both labels it is flat."""
    scale = float(np.sqrt(np.average(difference**2, weights=weight))) if len(difference) else 0.0
    shares = np.bincount(label, weight, minlength=2) if len(label) else np.zeros(2)
    start = float(np.log((shares[1] + 1) / (shares[0] + 1)))
    if not scale or not shares.all():
        return 0.0, start, 1.0
    x = np.stack([difference / scale, np.ones(len(difference))], axis=1)
    target, beta = label.astype(float), np.array([0.0, start])

    def loss(b: np.ndarray) -> float:
        margin = x @ b
        return float((weight * (np.logaddexp(0.0, margin) - target * margin)).sum()) + _RIDGE * float(b @ b) / 2

    for _ in range(100):  # Newton steps, halved until the loss falls
        p = _logistic(x @ beta)
        gradient = x.T @ (weight * (p - target)) + _RIDGE * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + _RIDGE * np.eye(2)
        step, now = np.linalg.solve(hessian, gradient), loss(beta)
        while loss(beta - step) > now and np.abs(step).max() > 1e-12:
            step /= 2
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1]), scale


def _sample_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, piece): pieces spread evenly over each text."""
    for batch in batches_by_bytes(batches, "text"):
        ids, labels, pieces = [], [], []
        rows = zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), batch.column("text").to_pylist())
        for doc_id, label, text in rows:
            raw = text.encode() if text else b""
            count = -(-len(raw) // PIECE)
            for k in sorted({count * i // PIECES_PER_TEXT for i in range(PIECES_PER_TEXT)}) if count else ():
                ids.append(doc_id)
                labels.append(label)
                pieces.append(raw[k * PIECE : (k + 1) * PIECE])
        columns = [pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(pieces, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "piece"])


def _ids(labelled: DataFrame, label: int, count: int) -> list[int]:
    order = F.xxhash64("doc_id")
    rows = labelled.where(F.col("label") == label).orderBy(order, "doc_id").limit(count)
    return [r.doc_id for r in rows.select("doc_id").collect()]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    texts: int = DICTIONARY_TEXTS,
    curve_texts: int = CURVE_TEXTS,
    size: int = DICTIONARY_BYTES,
) -> Model:
    """Learn from ``labels`` (doc_id, quality 0 or 1) of ``docs`` (doc_id, text).

    At most ``texts`` documents of each label, those with the smallest hashes of their ids,
    give up to eight pieces each to the dictionaries; the next ``curve_texts`` fit the
    curve, weighted so that the labels' shares are those of all rows of ``labels``. Only
    these pieces, and numbers, go to the driver. Documents labelled in both ways are left
    out, labels given more than once count once.
    """
    spark = docs.sparkSession
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("most"))
        .where(F.col("label") == F.col("most"))
        .select("doc_id", "label")
    )
    shares = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = []
    for label, count in shares.items():
        # Few labels are shared out, so that both parts have some.
        first = min(texts, -(-count // 2))
        ids = _ids(known, label, first + curve_texts)
        chosen += [(doc_id, label, place < first) for place, doc_id in enumerate(ids)]
    if not chosen:
        return Model(b"", b"")
    asked = F.broadcast(spark.createDataFrame(chosen, "doc_id bigint, label int, teaches boolean"))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(asked, "doc_id")

    cut = rows.where("teaches").select("doc_id", "label", "text").mapInArrow(
        _sample_pieces, "doc_id bigint, label int, piece binary"
    )
    pieces: dict[int, list[bytes]] = {0: [], 1: []}
    for label in shares:  # a limit for documents whose id occurs often
        of_label = cut.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "piece")
        pieces[label] = [bytes(r.piece) for r in of_label.limit(texts * PIECES_PER_TEXT).collect()]
    model = Model(dictionary(pieces[0], size), dictionary(pieces[1], size))
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text"):
            values = pa.array(shared.value.differences(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), values], ["doc_id", "label", "x"])

    measured = (
        rows.where(~F.col("teaches"))
        .select("doc_id", "label", "text")
        .mapInArrow(measure, "doc_id bigint, label int, x double")
        .groupBy("doc_id", "label")
        .agg(F.avg("x").alias("x"))  # of one id in several rows
        .orderBy("doc_id")
        .collect()
    )
    label = np.array([r.label for r in measured], np.int64)
    seen = np.bincount(label, minlength=2)
    weight = np.array([shares[k] / seen[k] if k in shares and seen[k] else 0.0 for k in (0, 1)])
    weight *= len(label) / max(weight @ seen, 1e-300)
    model.slope, model.offset, model.scale = curve(np.array([r.x for r in measured]), label, weight[label])
    return model


def with_quality(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text"):
            score = shared.value.scores(batch.column("text"))
            columns = [*map(batch.column, keep), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "score", "predicted"])

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    read = docs.select(*keep, *([] if "text" in keep else ["text"]))
    return read.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, *added]))


def _fold(folds: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from the labels of the other folds.

    Held out are ids whose crc32 is 0 modulo ``folds``; a null id is neither held out nor
    learned from. Null texts are empty; empty texts save nothing and get the curve's value
    at zero. Without labels every score is 0.5. Repeated rows are scored each; other columns
    are ignored.
    """
    model = fit(docs.select("doc_id", "text"), labels.where(_fold(folds) != 0).select("doc_id", "quality"))
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        F.col("text").cast("string"),
        F.coalesce(_fold(folds) == 0, F.lit(False)).alias("held_out"),
    )
    return with_quality(rows, model, ["doc_id", "held_out"], threshold)
