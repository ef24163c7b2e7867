"""Suffix-tree scores: base counts by hand, and distributions that sum to one."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from airgauge.llm import suffix_tree
from airgauge.llm.queries import QUERIES
from airgauge.session import ship_package
from tests.llm import cases


def plain_base(rows):
    tokens = [[*cases.words(t), None] for _, t in rows]
    learned = [d is not None and cases.crc(d) % 7 != 2 for d, _ in rows]
    counts = Counter(w for x, ok in zip(tokens, learned) if ok for w in x)
    total, kinds = sum(counts.values()), len(counts)
    return [
        (d, d is not None and not ok, len(x), sum(counts[w] > 0 for w in x), total,
         round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in x), 5))
        for (d, _), x, ok in zip(rows, tokens, learned)
    ]


def taken(frame):
    return [(*r[:5], round(r[5], 5)) for r in frame.collect()]


def test_hard_documents(spark, tmp_path):
    ship_package(spark)
    rows = cases.hard_texts()
    docs = cases.stored(spark, tmp_path, rows)
    scores = suffix_tree.suffix_scores(docs)
    assert cases.in_order(taken(scores)) == cases.in_order(plain_base(rows))
    repeated = [r for r in scores.collect() if r.doc_id in range(100, 160)]
    assert all(r.score > r.base_score for r in repeated)
    assert suffix_tree.suffix_scores(docs.limit(0)).count() == 0


def test_query_against_base(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert cases.in_order(taken(QUERIES["op9_suffix_tree"](spark, folder))) == cases.in_order(plain_base(docs))


def plain_tree(rows, depth=3, least=4, divergence=suffix_tree.DIVERGENCE):
    """{document: score}, states and probability function, from plain counts."""
    docs = [[*cases.words(t), None] for _, t in rows]
    learned = [x for x, (d, _) in zip(docs, rows) if d is not None and cases.crc(d) % 7 != 2]
    words = Counter(w for x in learned for w in x)
    total, kinds = sum(words.values()), len(words)
    context, pairs = Counter(), Counter()
    for x in learned:
        for i in range(1, len(x)):
            for k in range(1, min(depth, i) + 1):
                context[tuple(x[i - k : i])] += 1
                pairs[tuple(x[i - k : i]), x[i]] += 1
    pairs = {key: n for key, n in pairs.items() if n >= least}
    mass = Counter()
    for (c, _), n in pairs.items():
        mass[c] += n

    def root(word):
        return (words[word] + 1) / (total + kinds + 1)

    def step(c, word, shorter):
        weight = context[c] + suffix_tree.PRIOR
        return pairs.get((c, word), 0) / weight + (1 - mass[c] / weight) * shorter

    def full(c, word):
        return step(c, word, full(c[1:], word)) if c else root(word)

    gain, expected = Counter(), Counter()
    for (c, word), n in pairs.items():
        base = full(c[1:], word)
        gain[c] += n / context[c] * math.log(n / context[c] / base)
        expected[c] += base
    states = set()
    for c in sorted(mass, key=len, reverse=True):
        left = 1 - mass[c] / context[c]
        rest = left * math.log(left / max(1 - expected[c], 1e-12)) if left > 1e-12 else 0.0
        if gain[c] + rest >= divergence:
            states.update(c[i:] for i in range(len(c)))

    def probability(before, word):
        p = root(word)
        for k in range(1, min(depth, len(before)) + 1):
            if tuple(before[-k:]) in states:
                p = step(tuple(before[-k:]), word, p)
        return p

    scores = [sum(math.log10(probability(x[:i], x[i])) for i in range(len(x))) for x in docs]
    return scores, states, probability, words


def assert_scores(frame, rows):
    """Every document's tree score, as plain counts give it."""
    want = Counter((d, round(s, 4)) for (d, _), s in zip(rows, plain_tree(rows)[0]))
    got = Counter((r.doc_id, round(r.score, 4)) for r in frame.collect())
    for (d, s), n in got.items():  # the last digit may be rounded either way
        assert sum(want[d, round(s + e, 4)] for e in (-1e-4, 0.0, 1e-4)) >= n, (d, s)


@pytest.mark.parametrize("size", [8 << 20, 2000])
def test_scores_of_hard_documents(spark, tmp_path, monkeypatch, size):
    """Also where each chunk holds a few documents, and the keys of a level several blocks."""
    ship_package(spark)
    monkeypatch.setattr(suffix_tree, "CHUNK_BYTES", size)
    rng = random.Random(5)
    rows = [(d, t if t is None or len(t) < 100_000 else t[:20_000]) for d, t in cases.hard_texts()]
    rows += [(3000 + i, cases.sentence(rng, rng.randint(0, 80), 30)) for i in range(200)]
    docs = cases.stored(spark, tmp_path, rows)
    assert_scores(suffix_tree.suffix_scores(docs), rows)


def test_query_against_plain_counts(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert_scores(QUERIES["op9_suffix_tree"](spark, folder), docs)


def test_plain_distributions_sum_to_one():
    rng = random.Random(1)
    rows = [(i, cases.sentence(rng, 60, 8)) for i in range(60)]
    _, states, probability, words = plain_tree(rows)
    assert {len(c) for c in states} >= {1, 2}
    for before in ([], ["w1"], ["w3", "w2"], ["w1", "w5", "w0"]):
        unseen = probability(before, "never seen")
        assert sum(probability(before, w) for w in words) + unseen == pytest.approx(1)


def test_a_larger_corpus_forgets_nothing(spark, tmp_path):
    """Copies of a passage score alike alone and beside very many other documents."""
    ship_package(spark)
    rng = random.Random(2)
    passage = " ".join(f"p{rng.randrange(30)}" for _ in range(40))
    copies = [(i, passage) for i in range(48)]
    filler = [(1000 + i, cases.sentence(rng, 620, 4000)) for i in range(1000)]
    means = []
    for name, rows in (("alone", copies), ("beside", copies + filler)):
        scores = suffix_tree.suffix_scores(cases.stored(spark, tmp_path / name, rows)).collect()
        mine = [r for r in scores if r.doc_id < 48]
        # The first word has no context: its frequency is that of the corpus.
        learned = [t.split() for d, t in rows if cases.crc(d) % 7 != 2]
        count = sum(x.count(passage.split()[0]) for x in learned)
        kinds = len({w for x in learned for w in x}) + 1
        first = math.log10((count + 1) / (mine[0].train_tokens + kinds + 1))
        means.append(sum(r.score - first for r in mine) / 48)
        assert all(r.score > r.base_score / 5 for r in mine)
    assert means[1] == pytest.approx(means[0], rel=0.1)


def test_contexts_follow_divergence(spark, tmp_path):
    """A second-order source is scored far better than by its frequencies."""
    ship_package(spark)
    rng = random.Random(3)

    def text():
        out = [rng.randrange(5), rng.randrange(5)]
        while len(out) < 100:
            out.append((out[-1] * 2 + out[-2]) % 5 if rng.random() < 0.8 else rng.randrange(5))
        return " ".join(f"w{x}" for x in out)

    rows = [(i, text()) for i in range(80)]
    scores = suffix_tree.suffix_scores(cases.stored(spark, tmp_path, rows)).collect()
    assert all(r.score > r.base_score * 0.8 for r in scores)
    _, states, _, _ = plain_tree(rows)
    assert sum(len(c) == 2 for c in states) >= 20
