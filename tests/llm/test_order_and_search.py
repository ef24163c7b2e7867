"""Hilbert shards, exact search and license scans."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from airgauge.llm import cover_tree, hilbert, license_templates, licenses
from airgauge.llm.queries import QUERIES
from airgauge.session import fresh_folder, ship_package
from tests.llm import cases


@pytest.mark.parametrize("dimensions, bits", [(1, 4), (2, 4), (3, 3), (4, 2), (2, 1)])
def test_curve_visits_each_cell_once_and_steps_to_neighbours(dimensions, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    index = hilbert.curve_index(grid, bits)
    assert sorted(index.tolist()) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_of_hard_documents(spark, tmp_path, law):
    ship_package(spark)
    rows = cases.hard_texts()
    docs = cases.stored(spark, tmp_path, rows, lang=lambda i: None if i is None else f"l{i % 3}")
    got = hilbert.shard_documents(docs, law=law).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots: dict = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(8))
    if law == "rows":
        sizes = [len(slots.get(k, [])) for k in range(8)]
        assert max(sizes) - min(sizes) <= 1
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in got)
    assert hilbert.shard_documents(docs.limit(0), law=law).count() == 0
    with pytest.raises(ValueError):
        hilbert.shard_documents(docs, law="other")


def plain_cells(values, bits):
    """Cells of values cut at the ranks i * n / 2**bits; null is the lowest."""
    some = sorted(x for x in values if x is not None)
    cuts = sorted({some[i * len(some) >> bits] for i in range(1, 1 << bits)}) if some else []
    return [0 if x is None else sum(c < x for c in cuts) for x in values]


@pytest.mark.parametrize("prefix", ["s", "common_crawl_2024_"])
def test_shards_against_a_plain_curve_and_cut(spark, tmp_path, prefix):
    """Sources that differ in their last character only are told apart like any others."""
    ship_package(spark)
    rng = random.Random(9)
    rows = [(i, cases.sentence(rng, rng.randint(0, 60)), rng.choice(["de", "en", None]), f"{prefix}{rng.randrange(8)}") for i in range(3000)]
    rows += [(i, "copy", "en", f"{prefix}0") for i in range(1500)]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4).write.parquet(path)
    got = hilbert.shard_documents(spark.read.parquet(path)).collect()

    size = [len((t or "").encode()) + 1 for _, t, _, _ in rows]
    cells = np.array([plain_cells(x, hilbert.BITS) for x in ([r[2] for r in rows], [r[3] for r in rows], size)]).T
    curve = hilbert.curve_index(cells, hilbert.BITS)
    order = sorted((c, zlib.crc32((t or "").encode()), d) for c, (d, t, _, _) in zip(curve.tolist(), rows))
    bounds = [-(-len(rows) * k // 8) for k in range(9)]
    want = [(d, k, i - bounds[k]) for k in range(8) for i, (_, _, d) in enumerate(order) if bounds[k] <= i < bounds[k + 1]]
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted(want)
    shards = {}
    for r in got:
        shards.setdefault(r.source, set()).add(r.shard)
    assert len(shards) == 8 and np.mean([len(x) for x in shards.values()]) < 7


def test_shard_query_and_pruning(spark):
    got = QUERIES["op2_hilbert_shards"](spark, "/root/testdata/sf0.01")
    rows = got.collect()
    assert Counter(r.shard for r in rows) == Counter({k: 125 for k in range(8)})
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    # Narrow ranges: on average a shard's sizes span far less than all sizes do.
    ranks = {r.doc_id: i for i, r in enumerate(sorted(rows, key=lambda r: r.size))}
    spans = [np.ptp([ranks[r.doc_id] for r in rows if r.shard == k]) for k in range(8)]
    assert np.mean(spans) < 0.75 * len(rows)


def test_written_shards_are_whole(spark, tmp_path):
    ship_package(spark)
    rows = cases.hard_texts()
    docs = cases.stored(spark, tmp_path, rows).drop("shard")
    folder = fresh_folder(spark, "shards")
    hilbert.write_shards(docs, folder)
    back = spark.read.parquet(folder)
    assert cases.in_order(back.select("doc_id", "text").collect()) == cases.in_order(rows)
    assert set(back.columns) == {*docs.columns, "shard"}


def plain_search(rows, every, k, scale=256):
    good = [
        (i, v, np.floor(scale * np.array(x, np.float64)))
        for i, (v, x) in enumerate(rows)
        if v is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)
    ]
    out = []
    for i, v, x in good:
        if v % every == 0:
            scores = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), w) for j, w, y in good if j != i and len(y) == len(x))[:k]
            out += [(v, rank + 1, w, -s if abs(s) < 1 << 63 else None) for rank, (s, w) in enumerate(scores)]
    return out


@pytest.mark.parametrize("block, queries", [(4096, 2048), (40, 7)])
@pytest.mark.parametrize("large", [(), (5000.0, 2e5), (3e6, -1e30, 3.4e38)])
def test_search_of_hard_vectors(spark, tmp_path, monkeypatch, block, queries, large):
    ship_package(spark)
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "QUERIES_PER_BLOCK", queries)
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (6, 8))
    rows = [(i, (centers[i % 6] + rng.normal(0, 0.1, 8)).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(120)] + [(400, [0.5] * 8)]  # ties, and repeated rows
    rows += [(None, [1.0] * 8), (1000, None), (1001, [None] * 8), (1050, [float("nan")] * 8), (1100, [float("inf")] * 8)]
    rows += [(3000 + 25 * i, [x] * 4 + [1.0, -x, 0.5, 0.25]) for i, x in enumerate(large * 2)]
    rows += [(2000, [1.0, 2.0]), (2001, [2.0, 1.0]), (2002, [1.0, 2.0]), (2050, []), (-50, [0.25] * 8)]
    path = str(tmp_path / "vectors.parquet")
    frame = spark.createDataFrame([(v, x, "clash") for v, x in rows], "vec_id bigint, embedding array<float>, place string")
    frame.repartition(3).write.parquet(path)
    vectors = spark.read.parquet(path)
    stored = [(v, None if x is None else [None if y is None else float(np.float32(y)) for y in x]) for v, x in rows]
    got = cover_tree.top_inner_products(vectors).collect()
    assert cases.in_order(got) == cases.in_order(plain_search(stored, 50, 5))
    assert cover_tree.top_inner_products(vectors.limit(0)).count() == 0


def test_cover_tree_covers():
    points = np.random.default_rng(1).normal(0, 1, (500, 5))
    tree = cover_tree.CoverTree(points)
    for node, members in enumerate(tree.members):
        center = points[tree.centers[node]]
        assert np.linalg.norm(points[members] - center, axis=1).max() <= tree.radius[node] + 1e-9
        children = tree.children[node]
        if children:
            assert sorted(np.concatenate([tree.members[c] for c in children]).tolist()) == sorted(members.tolist())
            centers = points[[tree.centers[c] for c in children]]
            gaps = np.linalg.norm(centers[:, None] - centers[None], axis=2)[np.triu_indices(len(children), 1)]
            assert (gaps > tree.radius[node] / cover_tree.BASE).all()


@pytest.mark.parametrize("asked", [slice(0, 50), slice(0, 2000, 40)], ids=["near", "far apart"])
def test_search_prunes(asked):
    rng = np.random.default_rng(2)
    data = np.repeat(rng.normal(0, 100, (40, 16)), 50, axis=0) + rng.normal(0, 1, (2000, 16))
    own = np.arange(2000)[asked]
    search = cover_tree.Search(data[asked], own, cover_tree.CoverTree(data[asked]), 5)
    seen = []
    leaf = search._leaf
    search._leaf = lambda q, d, i, p, rows: (seen.append(len(q) * len(rows)), leaf(q, d, i, p, rows))
    search.run(data, np.arange(2000), np.arange(2000), cover_tree.CoverTree(data))
    assert sum(seen) < 0.2 * 50 * 2000
    scores = data[asked] @ data.T
    scores[np.arange(50), own] = -np.inf
    assert np.allclose(search.scores, -np.sort(-scores, axis=1)[:, :5])


def plain_licenses(texts, templates, num=8, den=10):
    """Every window of every template's length, by sets."""

    def grams(text):
        w = cases.words(text, cases.ALNUM)
        return list(zip(w, w[1:]))

    known = [(name, grams(text)) for name, text in sorted(templates.items())]
    out = []
    for text in texts:
        own = grams(text)
        compared, best = 0, None
        for name, listed in known:
            b = set(listed)
            windows = [(-sum(g in b for g in own[i : i + len(listed)]), i) for i, g in enumerate(own) if g in b]
            if not windows:
                continue
            shared, i = min(windows)
            if -shared * (2 * den - num) < num * len(b):
                continue
            compared += 1
            a = set(own[i : i + len(listed)])
            common, total = len(a & b), len(a) + len(b)
            key = (-common / total, -total, name)
            if 2 * den * common >= num * total and (best is None or key < best[0]):
                best = (key, name.split()[0], name, common, total, i)
        out.append((compared, *(best[1:] if best else (None,) * 5)))
    return out


SHORT = {name: text for name, text in license_templates.templates().items() if len(text) < 2500}


def test_licenses_of_hard_texts():
    rng = random.Random(6)
    texts = [t for _, t in cases.hard_texts()[:14]]
    for text in SHORT.values():
        w = text.split()
        texts += [text, f"intro words\n{text}\nmore", f"{text} {cases.sentence(rng, 3)} {text}", " ".join(w[len(w) // 2 :])]
        texts += ["\r\n".join("# " + " ".join(w[i : i + 7]) for i in range(0, len(w), 7)), " ".join(x for x in w if rng.random() > 0.06)]
    known = licenses.Templates.of(SHORT)
    got = licenses.scan(pa.array(texts, pa.string()), known, licenses.LEAST)
    assert got == plain_licenses(texts, SHORT)
    assert got == [licenses.scan(pa.array([t], pa.string()), known, licenses.LEAST)[0] for t in texts]
    assert licenses.scan(pa.array(["of the", None]), licenses.Templates.of({"x": "word"}), licenses.LEAST) == [licenses.NO_LICENSE] * 2


GNU = (
    "This program is free software; you can redistribute it and/or modify it under the terms of {0} as published by the "
    "Free Software Foundation; either version {1}, or (at your option) any later version. This program is distributed "
    "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
    "or FITNESS FOR A PARTICULAR PURPOSE. See {0} for more details."
)


@pytest.mark.parametrize(
    "license_, text",
    [
        ("AGPL-3.0", GNU.format("the GNU Affero General Public License", "3 of the License")),
        ("GPL-2.0", GNU.format("the GNU General Public License", "2 of the License")),
        ("GPL-3.0", GNU.format("the GNU General Public License", "3 of the License")),
        ("LGPL-3.0", GNU.format("the GNU Lesser General Public License", "3 of the License").replace("program", "library")),
        ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
        ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
        ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
        ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
        ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
        ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 A B\n\n" + SHORT["MIT text"]),
        ("Apache-2.0", "See the manual, which is licensed under the Apache License, Version 2.0, and the notes that came with it."),
        (None, "The license of the software is the one that the authors of the work released it under in that version."),
    ],
)
def test_licenses_are_told_apart(license_, text):
    known = licenses.Templates.of(license_templates.templates())
    for form in (text, f"{text}\nand then much else was said about it", "\r\n".join(f" * {x}" for x in text.splitlines())):
        assert licenses.scan(pa.array([form]), known, licenses.LEAST)[0][1] == license_


def test_complete_texts_are_found():
    """Each template inside a longer text, wrapped, commented and with words left out."""
    known, rng = licenses.Templates.of(license_templates.templates()), random.Random(3)
    for name, text in license_templates.templates().items():
        w = text.split()
        wrapped = "\r\n".join("// " + " ".join(w[i : i + 9]) for i in range(0, len(w), 9))
        forms = [f"{cases.sentence(rng, 40)} {text} {cases.sentence(rng, 40)}", wrapped]
        if len(w) > 60:
            forms.append(" ".join(x for x in w if rng.random() > 0.04))
        got = licenses.scan(pa.array(forms), known, licenses.LEAST)
        assert {r[1] for r in got} == {name.split()[0]}, name


def test_license_scan_of_hard_documents(spark, tmp_path):
    ship_package(spark)
    rows = cases.hard_texts() + [(700, "Released under the MIT License.")]
    docs = cases.stored(spark, tmp_path, rows)
    got = licenses.license_scan(docs)
    assert got.where(F.col("license") == "MIT").select("doc_id", "word").collect() == [(700, 0)]
    assert cases.in_order(got.select("doc_id").collect()) == cases.in_order((d,) for d, _ in rows)
    assert licenses.license_scan(docs.limit(0)).count() == 0
