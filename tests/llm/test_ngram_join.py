"""The n-gram Jaccard join against comparing all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from airgauge.llm import components, ngram_join
from airgauge.session import ship_package
from tests.llm import cases


def found(docs, **how):
    rows = ngram_join.linked_documents(docs, **how).select("doc_id", "n_shingles", "component_id").collect()
    return cases.in_order(rows)


def families(seed: int, count: int, members: int, size: int, edits: int):
    """Families of near copies around the limit, with short texts, shared passages and copies."""
    rng = random.Random(seed)
    passage = cases.sentence(rng, 12)
    rows, doc_id = [], 0
    for _ in range(count):
        base = cases.sentence(rng, rng.randint(size // 2, size), 300).split()
        for _ in range(rng.randint(1, members)):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(40)}"
            if rng.random() < 0.2:
                own = passage.split() + own
            rows.append((doc_id, " ".join(own)))
            doc_id += rng.randint(1, 3)
    rng.shuffle(rows)
    return rows


def test_hard_documents(spark, tmp_path):
    ship_package(spark)
    rows = cases.hard_texts()
    docs = cases.stored(spark, tmp_path, rows)
    assert found(docs) == cases.in_order(cases.components(rows))
    assert found(docs.limit(0)) == []


@pytest.mark.parametrize("seed, count, members, size, edits", [(1, 40, 12, 60, 4), (2, 6, 70, 130, 4), (3, 120, 4, 12, 2)])
def test_families(spark, tmp_path, seed, count, members, size, edits):
    ship_package(spark)
    rows = families(seed, count, members, size, edits)
    docs = cases.stored(spark, tmp_path, rows)
    assert found(docs) == cases.in_order(cases.components(rows))
    looser = {"shingle": 5, "similarity": (80, 100)}
    assert found(docs, **looser) == cases.in_order(cases.components(rows, 5, 80, 100))


def test_groups_of_equal_prefix(spark, tmp_path, monkeypatch):
    """Without any difference in frequency the order is that of hashes, and groups have several members."""
    ship_package(spark)
    monkeypatch.setattr(
        ngram_join, "_frequencies", lambda docs, size: np.zeros(1 << ngram_join.COUNTER_BITS, np.uint8)
    )
    rows = families(7, 10, 40, 90, 3)
    docs = cases.stored(spark, tmp_path, rows)
    assert found(docs) == cases.in_order(cases.components(rows))


@pytest.mark.parametrize("large", [4, 40])
def test_large_buckets_are_met_in_blocks(spark, tmp_path, monkeypatch, large):
    ship_package(spark)
    monkeypatch.setattr(ngram_join, "LARGE", large)
    monkeypatch.setattr(
        ngram_join, "_frequencies", lambda docs, size: np.zeros(1 << ngram_join.COUNTER_BITS, np.uint8)
    )
    rows = families(11, 8, 60, 60, 3)
    docs = cases.stored(spark, tmp_path, rows)
    assert found(docs) == cases.in_order(cases.components(rows))


@pytest.mark.parametrize("large", [3, 50, 10_000])
def test_cross_pairs_by_hand(spark, large):
    """All pairs of a bucket that can match and lie in different components, at any size of blocks."""
    rng = random.Random(large)
    rows = [(t, rng.randrange(4), rng.randint(20, 60), rng.choice([7, 7, 7, *range(20, 30)]), 1000 * t + i) for t, size in ((1, 300), (2, 90), (3, 9), (4, 1)) for i in range(size)]
    rows += [(5, 0, 30, 8, 9000 + i) for i in range(400)]  # one component only
    frame = spark.createDataFrame(rows, "token bigint, pos bigint, n bigint, comp bigint, head bigint")
    got = ngram_join._cross_pairs(frame, lambda part: part, (90, 100), large).collect()
    want = set()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[4] < y[4] and x[3] != y[3]:
                need = -(-90 * (x[2] + y[2]) // 190)
                if min(x[2], y[2]) * 100 >= 90 * max(x[2], y[2]) and min(x[2] - x[1], y[2] - y[1]) >= need:
                    want.add((x[4], y[4]))
    assert sorted(map(tuple, got)) == sorted(want)


def test_keep_one(spark, tmp_path):
    ship_package(spark)
    rows = cases.hard_texts()
    docs = cases.stored(spark, tmp_path, rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    groups: dict = {}
    for (doc_id, n, component), (_, text) in zip(cases.components(rows, 5, 80, 100), rows):
        groups.setdefault(("links", component) if n else ("alone", len(groups)), []).append((doc_id is None, doc_id, text))
    want = [(x[1], x[2]) for x in (min(g, key=lambda y: (y[0], y[1] or 0)) for g in groups.values())]
    assert cases.in_order(kept.select("doc_id", "text").collect()) == cases.in_order(want)


def test_shingles_tell_words_apart():
    sets = ngram_join.shingle_sets(pa.array(["a b c d", "A\tB C  D", "a b", "b a", "ab", "", None, "a b c a b c"]))
    assert sets[0].tolist() == sets[1].tolist()
    assert [len(x) for x in sets] == [2, 2, 1, 1, 1, 0, 0, 3]
    assert len({int(x[0]) for x in sets[2:5]}) == 3


def test_components_of_any_graph(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 40)] + [(9, 9)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in components.connected(frame).collect()}
    assert got == {x: r for x, r in root.items() if sum(v == r for v in root.values()) > 1}
    assert components.connected(frame.limit(0)).count() == 0


def test_signs_of_different_width_fold_to_lower_bounds():
    rng = np.random.default_rng(3)
    whole = rng.integers(0, 1 << 63, 3000).astype(np.uint64)

    def sign(found, parts):
        odd = np.bincount((found & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
        return np.packbits(odd.astype(np.uint8)).reshape(1, -1)

    wide, narrow = sign(whole, 2048), sign(whole, 1024)
    assert (ngram_join._folded(wide, 128) == narrow).all()
    other = sign(whole[50:], 1024)
    differ = int(np.bitwise_count(ngram_join._folded(wide, 128) ^ other).sum())
    assert 0 < differ <= 50
