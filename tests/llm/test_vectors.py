"""Whitening and centroid clusters against plain versions, on hard vectors."""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pytest

from airgauge.llm import bidiagonal, centroids, whitening
from airgauge.llm.queries import QUERIES
from airgauge.session import ship_package
from tests.llm import cases

SCHEMA = "vec_id bigint, embedding array<float>, dim string, data string, cluster string, component string, n string"


def hard_vectors(dim: int, count: int = 400, large: bool = False):
    rng = np.random.default_rng(dim)
    rows = [(i, rng.normal(i % 5, 0.3, dim).tolist()) for i in range(count)]
    rows += [(1000 + i, rows[7][1]) for i in range(count // 2)]  # a third are copies
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]  # repeated and missing ids
    rows += [(2001, None), (2002, []), (2003, [None] + [0.0] * (dim - 1)), (2004, [float("nan")] * dim)]
    rows += [(2005, [float("inf")] + [0.0] * (dim - 1)), (2006, [1.0] * (dim + 1)), (2007, [-5000.0] * dim)]
    if large:
        rows += [(2008, [1e30] + [0.0] * (dim - 1)), (2009, [3e6] * dim)]
    return rows


def stored(spark, folder, rows):
    path = str(folder / "vectors.parquet")
    spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def sound(rows, dim):
    return [(i, np.float32(x)) for i, x in rows if x is not None and len(x) == dim and None not in x and np.isfinite(x).all()]


# ---------------------------------------------------------------- bidiagonal qd


@pytest.mark.parametrize("name", ["random", "graded", "few rows", "equal columns", "two values", "zero", "one"])
def test_directions(name):
    rng = np.random.default_rng(2)
    q1, q2 = (np.linalg.qr(rng.normal(size=(40, 40)))[0] for _ in range(2))
    x = {
        "random": rng.normal(size=(300, 40)),
        "graded": rng.normal(size=(300, 40)) * 10.0 ** -np.linspace(0, 8, 40),
        "few rows": rng.normal(size=(9, 40)),
        "equal columns": np.repeat(rng.normal(size=(90, 5)), 8, axis=1),
        "two values": q1 @ np.diag([1.0] * 20 + [2.0] * 20) @ q2,
        "zero": np.zeros((9, 40)),
        "one": rng.normal(size=(50, 1)),
    }[name]
    size = x.shape[1]
    triangle = np.zeros((size, size))
    r = np.linalg.qr(x, mode="r")
    triangle[: len(r)] = r
    values, right = bidiagonal.directions(triangle)
    want = np.zeros(size)
    singular = np.linalg.svd(x, compute_uv=False) ** 2
    want[: len(singular)] = singular
    assert np.allclose(values, want, rtol=1e-10, atol=1e-20 * (want[0] + 1))
    assert np.abs(right.T @ right - np.eye(size)).max() < 1e-11
    assert np.abs(x.T @ (x @ right) - right * values).max() <= 1e-13 * (want[0] + 1e-300) + 1e-300


# ---------------------------------------------------------------- whitening


def plain_whitening(vectors, components=32):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} from whole numbers and a plain SVD."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums)] for row in x])
    # The covariance would lose the small variances beside a large one.
    _, singular, right = np.linalg.svd(centred, full_matrices=False)
    values, right = singular**2 / n, right.T
    white = centred @ right / np.sqrt(np.maximum(values, 1e-300))
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    keep = [k for k in range(min(components, len(values))) if values[k] > 1e-18 * values[0]]
    return [
        (i, k + 1, n, deviation[j], abs(white[j, k]), values[k] / values.sum())
        for j, (i, _) in enumerate(vectors)
        for k in keep
    ]


@pytest.mark.parametrize("dim", [6, 40])
def test_whitening_of_hard_vectors(spark, tmp_path, dim):
    ship_package(spark)
    rows = hard_vectors(dim)
    got = whitening.whitened(stored(spark, tmp_path, rows)).collect()
    want = plain_whitening(sound(rows, dim))
    assert len(got) == len(want)

    def order(r):
        return (r[0] is None, r[0] or 0, r[1], float(r[3]), float(r[4]))

    mine = sorted(((r.vec_id, r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in got), key=order)
    for a, b in zip(mine, sorted(want, key=order)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-6, abs=1e-7) and a[5] == pytest.approx(b[5], rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    signed = {}
    for r in got:  # one sign for all rows: components are uncorrelated, with their mean at zero
        signed.setdefault(r.component, []).append(r.whitened)
    assert all(abs(np.mean(x)) < 1e-9 for x in signed.values())


def test_whitening_without_variance(spark, tmp_path):
    ship_package(spark)
    assert whitening.whitened(stored(spark, tmp_path / "a", [(1, [1.0, 2.0])] * 9)).count() == 0
    assert whitening.whitened(stored(spark, tmp_path / "b", [(1, None), (2, [])])).count() == 0
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]  # one dimension of variance in three
    got = whitening.whitened(stored(spark, tmp_path / "c", flat)).collect()
    assert len(got) == 20 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)
    wide = [(i, [float(i), float(-i * i)]) for i in range(20)] + [(50, [1e30, 0.0])]
    got = whitening.whitened(stored(spark, tmp_path / "d", wide)).collect()
    assert {r.component for r in got} == {1} and any(r.deviation is None for r in got)


def test_whitening_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = {(i, k): rest for i, k, *rest in plain_whitening(sound(rows, len(rows[0][1])))}
    frame = QUERIES["op11_whitening"](spark, folder)
    assert dict(frame.dtypes)["deviation"] == "bigint"
    got = frame.collect()
    assert len(got) == len(want)
    for r in got:
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(white, rel=1e-6, abs=1e-7)
        assert r.explained == pytest.approx(explained, rel=1e-6) and r.identity_error < 1e-4


# ---------------------------------------------------------------- clusters


def plain_clusters(vectors, clusters=8, rounds=10, scale=1024):
    x = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in vectors]
    named = [(hashlib.sha256(f"3:{i}".encode()).hexdigest(), np.float64(v).tobytes(), y) for (i, v), (_, y) in zip(vectors, x) if i is not None]
    table = [y for *_, y in sorted(named)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(table))

    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in x]
        for k in range(len(table)):
            mine = [v for (_, v), f in zip(x, found) if f == k]
            if mine:
                table[k] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [nearest(v) for _, v in x]
    every = sum(d for d, _ in last)
    return [
        (i, k, d, sum(e for e, j in last if j == k), every, hashlib.sha256(",".join(map(str, table[k])).encode()).hexdigest())
        for (i, _), (d, k) in zip(x, last)
    ]


def taken(frame):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return cases.in_order([tuple(r[n] for n in names) for r in frame.collect()])


def limited(rows):
    """Sums beyond 64 bits are null."""
    return cases.in_order([(*r[:2], *(x if x is None or x < 1 << 63 else None for x in r[2:5]), r[5]) for r in rows])


@pytest.mark.parametrize("large", [False, True])
def test_clusters_of_hard_vectors(spark, tmp_path, large):
    ship_package(spark)
    rows = hard_vectors(6, large=large)
    got = centroids.clustered(stored(spark, tmp_path, rows), dim=6)
    assert taken(got) == limited(plain_clusters(sound(rows, 6)))


def test_few_vectors_and_ties(spark, tmp_path):
    ship_package(spark)
    assert centroids.clustered(stored(spark, tmp_path / "a", [(1, None), (2, [])])).count() == 0
    rows = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])] * 5
    got = centroids.clustered(stored(spark, tmp_path / "b", rows), clusters=2, dim=2)
    assert taken(got) == limited(plain_clusters(sound(rows, 2), clusters=2))
    lone = [(None, [1.0, 0.0]), (None, [4.0, 1.0])]
    assert centroids.clustered(stored(spark, tmp_path / "c", lone), dim=2).count() == 2


def test_search_is_exact_and_prunes():
    rng = np.random.default_rng(4)
    centres = rng.integers(-900, 900, (300, 16))
    table = centroids.Centroids.of(np.concatenate([centres, centres[:9]]).astype(object))
    vectors = centres[rng.integers(0, 300, 2000)] + rng.integers(-40, 40, (2000, 16))
    number, distance, compared = table.nearest(vectors)
    every = ((vectors[:, None, :] - np.concatenate([centres, centres[:9]])[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert compared < every.size / 10
    wide, far, _ = table.nearest(vectors.astype(object))
    assert (wide == number).all() and (far == distance).all()
