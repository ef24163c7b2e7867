"""Compression classifier: held-out accuracy, sizes by hand, and hard documents."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from airgauge.llm import compression
from airgauge.llm.queries import QUERIES
from airgauge.session import ship_package
from tests.llm import cases

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    docs = Counter(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())
    got = QUERIES["op12_compression"](spark, FOLDER).collect()
    assert Counter(r.doc_id for r in got) == docs
    for r in got:
        assert r.held_out == (cases.crc(r.doc_id) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    for label in (0, 1):
        assert np.mean([p == label for p, y in held if y == label]) > (0.75, 0.97)[label]


def test_sizes_by_hand():
    """A text's difference is that of all its pieces, compressed one by one."""
    good, bad = b"of the people and the order of things " * 40, b"BUY NOW!! $$$ " * 90
    model = compression.Model(bad, good)
    texts = ["of the people and the order of things", "BUY NOW!! $$$", "", None, "of the order BUY NOW!! " * 200]

    def size(raw, known):
        c = zstandard.ZstdCompressor(
            level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(known), write_content_size=False, write_dict_id=False
        )
        return sum(len(c.compress(raw[i : i + compression.PIECE])) for i in range(0, len(raw), compression.PIECE))

    got = model.differences(pa.array(texts, pa.string()))
    for text, value in zip(texts, got.tolist()):
        raw = (text or "").encode()
        assert value == pytest.approx((size(raw, bad) - size(raw, good)) / len(raw) if raw else 0.0)
    assert got[0] > 0 > got[1] and got[2] == got[3] == 0


def test_curve():
    rng = np.random.default_rng(1)
    x = rng.normal(0.05, 0.1, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(30 * x - 1)))).astype(int)
    slope, offset, scale = compression.curve(x, y, np.ones(4000))
    assert slope / scale == pytest.approx(30, rel=0.1) and offset == pytest.approx(-1, abs=0.2)
    # Classes far apart end in a steep curve, one class and no rows in a flat one.
    steep, _, _ = compression.curve(np.array([-1.0, 1.0]), np.array([0, 1]), np.ones(2))
    assert np.isfinite(steep) and steep > 3
    assert compression.curve(x, np.ones(4000, int), np.ones(4000))[0] == 0
    assert compression.curve(np.zeros(0), np.zeros(0, int), np.zeros(0)) == (0.0, 0.0, 1.0)


def test_hard_documents(spark, tmp_path):
    ship_package(spark)
    rng = random.Random(3)
    rows = cases.hard_texts()
    rows += [(1000 + i, cases.sentence(rng, 80)) for i in range(120)]
    rows += [(2000 + i, " ".join(rng.choice(["$$$", "BUY!!", "NOW!!", "###"]) for _ in range(150))) for i in range(120)]
    docs = cases.stored(spark, tmp_path, rows)
    marked = [(i, 1, "x") for i in (*range(1000, 1120), *range(100, 160))] + [(2000 + i, 0, "x") for i in range(120)]
    marked += [(1000, 0, "x"), (1001, 1, "x"), (1002, None, "x"), (None, 1, "x"), (1003, 7, "x"), (99999, 0, "x")]
    labels = spark.createDataFrame(marked, "doc_id bigint, quality int, text string")
    got = compression.quality_scores(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].predicted == 1 for i in range(1004, 1120)) and by_id[12].predicted == 1
    assert all(by_id[2000 + i].predicted == 0 for i in range(120))
    assert by_id[1].score == by_id[2].score  # null and empty
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert compression.quality_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in compression.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    one = labels.where("quality = 1")
    assert all(r.score > 0.5 for r in compression.quality_scores(docs, one).collect())


def test_learning_ignores_the_held_out_fold(spark, tmp_path):
    """Labels of held-out documents change nothing."""
    ship_package(spark)
    rng = random.Random(8)
    rows = [(i, cases.sentence(rng, 60) if i % 2 else "!!! $$$ ### " * 30) for i in range(200)]
    docs = cases.stored(spark, tmp_path, rows)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    turned = spark.createDataFrame(
        [(i, i % 2 if cases.crc(i) % 5 else 1 - i % 2) for i, _ in rows], "doc_id bigint, quality int"
    )
    first, second = (sorted(map(tuple, compression.quality_scores(docs, x).collect())) for x in (labels, turned))
    assert first == second
