"""FM-index and benchmark decontamination against plain search."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from airgauge.llm import decontaminate
from airgauge.llm.fmindex import FMIndex, suffix_array
from airgauge.session import ship_package
from tests.llm import cases

RUNS = st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=8)


@settings(max_examples=80, deadline=None)
@given(RUNS, st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=6), min_size=1, max_size=8))
def test_occurrences(runs, phrases):
    text = np.array([x for run in [*runs, *runs] for x in [*run, 0]])
    assert sorted(suffix_array(text).tolist()) == list(range(len(text)))
    patterns = np.zeros((len(phrases), 10), np.int64)
    for row, phrase in zip(patterns, phrases):
        row[: len(phrase)] = phrase
    which, where = FMIndex(text, 4).occurrences(patterns, np.array([len(x) for x in phrases]))
    plain = text.tolist()
    want = [(i, k) for i, p in enumerate(phrases) for k in range(len(plain)) if plain[k : k + len(p)] == p]
    assert sorted(zip(which.tolist(), where.tolist())) == want


def plain(rows, items, window=10):
    phrases = [
        (str(i), tuple(w[k : k + window]))
        for i, text in items
        if i is not None and (w := cases.words(text, cases.ALNUM))
        for k in range(max(1, len(w) - window + 1))
    ]
    out = []
    for doc_id, text in rows:
        w, hit, names = cases.words(text, cases.ALNUM), set(), set()
        for name, phrase in phrases:
            for k in range(len(w) - len(phrase) + 1):
                if tuple(w[k : k + len(phrase)]) == phrase:
                    hit.update(range(k, k + len(phrase)))
                    names.add(name)
        out.append((doc_id, len(w), len(hit), sorted(names)))
    return out


def hard_case():
    rng = random.Random(8)
    items = [(2, cases.sentence(rng, 25)), (10, cases.sentence(rng, 10)), (3, "Short, ITEM"), (4, "one"), (5, None), (6, " ... "), (None, "w1 w2")]
    items.append((7, items[0][1]))
    quoted = [f"x y {t.upper() if t else ''} z" for _, t in items] + [items[0][1] + " " + items[0][1], "one " * 50]
    part = " ".join(items[0][1].split()[4:15])
    rows = cases.hard_texts()[:12] + [(500 + i, t) for i, t in enumerate([*quoted, part, part.replace(" ", ", "), part[3:]])]
    return rows, items


def test_hard_documents(spark, tmp_path, monkeypatch):
    ship_package(spark)
    rows, items = hard_case()
    docs = cases.stored(spark, tmp_path, rows)
    benchmark = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, words string")
    want = plain(rows, items)
    # All items at once, each in a block of its own, and each in a pass of its own.
    for block_words, pass_bytes in ((decontaminate.BLOCK_WORDS, 1 << 20), (1, 1 << 20), (1, 1)):
        monkeypatch.setattr(decontaminate.phrase_blocks, "__defaults__", (10, block_words))
        monkeypatch.setattr(decontaminate._passes, "__defaults__", (pass_bytes,))
        got = decontaminate.contamination(docs, benchmark).collect()
        assert cases.in_order((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == cases.in_order(want)
    texts: dict = {}
    for d, t in rows:
        texts.setdefault(d, t)
    for r in got:
        left = decontaminate.cut(texts[r.doc_id], [x.asDict() for x in r.removed]) if r.doc_id is not None else None
        if left is not None:
            assert len(cases.words(left, cases.ALNUM)) == r.n_words - r.n_hit
    clean = decontaminate.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert cases.in_order(clean.select("doc_id").collect()) == cases.in_order((d,) for d, _, hit, _ in want if not hit)
    assert decontaminate.keep_clean(docs, benchmark.limit(0)).count() == len(rows)
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0
