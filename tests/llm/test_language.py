"""Language ID: held-out accuracy, batches, and hard documents."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from airgauge.llm import language
from airgauge.llm.queries import QUERIES
from airgauge.session import ship_package
from tests.llm import cases

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op6_language"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (cases.crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98


def test_counts_and_scores_by_hand():
    """A model of two languages gives each text the sum of its n-grams' log probabilities."""
    texts = ["Ab c", "", "?? 12", "äß"]
    buckets, owners, letters = language.ngrams(pa.array(texts))
    assert letters.tolist() == [3, 0, 0, 2] and set(owners.tolist()) == {0, 3}
    alone = [language.ngrams(pa.array([t])) for t in texts]
    for i, (own, _, _) in enumerate(alone):  # neighbours in a batch change nothing
        assert Counter(buckets[owners == i].tolist()) == Counter(own.tolist())
    # one, two and three characters: "ab c" has 3 letters, 6 pairs and 6 triples with one
    assert len(alone[0][0]) == 3 + 5 + 6
    matrix = np.log(np.random.default_rng(1).random((language.BUCKETS, 2)))
    model = language.Model(["x", "y"], np.asfortranarray(matrix, np.float32), np.log([0.4, 0.6]))
    names, score = model.predict(pa.array(texts))
    sums = matrix[alone[0][0]].sum(axis=0) + np.log([0.4, 0.6])
    assert names[0] == "xy"[int(sums.argmax())] and names[1:3] == ["und", "und"] and score[1] == 0
    assert score[0] == pytest.approx(1 / (1 + math.exp(sums.min() - sums.max())), rel=1e-4)


def plain_ngrams(text):
    """Runs of one to three characters that hold a letter, of the lower-cased text in spaces."""
    padded = "  " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    # A run may reach into the spaces behind the text by one; the last begins on the closing space.
    return [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded)) if any(c.isalpha() for c in padded[i : i + n])]


def test_training_against_plain_counts(spark, tmp_path):
    """Counts of all labelled texts, smoothed, and the shares of the languages."""
    ship_package(spark)
    rows = [(i, t) for i, t in cases.hard_texts() if i != 12] + [(900 + i, "Straße über öde Häuser") for i in range(9)]
    docs = cases.stored(spark, tmp_path, rows, lang=lambda i: None if i is None or i % 7 == 0 else ("de" if i >= 900 else "en"))
    model = language.fit(docs.select("text", "lang"))
    assert model.languages == ["de", "en"]
    labelled = [(r.text, r.lang) for r in docs.collect() if r.lang and r.text]
    texts = {k: [t for t, x in labelled if x == k and any(c.isalpha() for c in t)] for k in model.languages}
    for k, name in enumerate(model.languages):
        counts: Counter = Counter()
        for text in texts[name]:
            buckets, _, _ = language.ngrams(pa.array([text]))
            assert len(buckets) == len(plain_ngrams(text))
            counts.update(buckets.tolist())
        total = sum(counts.values()) + language.SMOOTHING * language.BUCKETS
        want = np.full(language.BUCKETS, math.log(language.SMOOTHING / total))
        for bucket, n in counts.items():
            want[bucket] = math.log((n + language.SMOOTHING) / total)
        assert np.allclose(model.matrix[:, k], want, rtol=1e-5)
        both = sum(map(len, texts.values()))
        assert model.prior[k] == pytest.approx(math.log((len(texts[name]) + 1) / (both + 2)))


def test_hard_documents(spark, tmp_path):
    ship_package(spark)
    rows = cases.hard_texts() + [(900 + i, "Straße über öde Häuser") for i in range(9)]
    docs = cases.stored(spark, tmp_path, rows, lang=lambda i: None if i is None else ("de" if i >= 900 else "en"))
    got = language.identify(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[i] for i in (1, 2, 3, 13)] == ["und"] * 4 and by_id[10] == "en" and by_id[905] == "de"
    assert not any(r.held_out for r in got if r.doc_id is None)
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns
    texts = {t for (t,) in kept.select("text").collect()}
    assert None not in texts and "" not in texts and "Straße über öde Häuser" in texts
    nothing = docs.limit(0)
    assert language.identify(nothing).count() == 0
    unlabelled = cases.stored(spark, tmp_path / "u", rows)
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
