"""Singular values and right singular vectors of a small upper triangle, by qd recurrences.

The triangle is brought to upper bidiagonal form by Householder reflections. The
differential qd algorithm with shifts gives the squared singular values, all to high
relative accuracy. Each direction comes from a twisted factorisation of the shifted
product: the stationary recurrence from the top meets the progressive one from the
bottom where the pivot is smallest.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(np.float64).eps)
_NEGLIGIBLE = (10 * _EPS) ** 2  # of a square against its neighbours
_CLOSE = 1e-4  # values closer than this share of them have their directions made orthogonal


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta with (I - beta v v') x = (+-|x|, 0, ..., 0)."""
    largest = np.abs(x).max(initial=0.0)
    v = np.zeros_like(x)
    v[:1] = 1.0
    if not largest:
        return v, 0.0
    y = x / largest
    norm = float(np.sqrt(y @ y))
    v = y.copy()
    v[0] += norm if y[0] >= 0 else -norm
    return v, 2.0 / float(v @ v)


def bidiagonal(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, right): triangle = left * (a on the diagonal, b above) * right', left and right orthogonal."""
    m = np.array(triangle, np.float64)
    size = len(m)
    right = np.eye(size)
    for k in range(size):
        v, beta = _reflector(m[k:, k])
        m[k:, k:] -= beta * np.outer(v, v @ m[k:, k:])
        if k < size - 2:
            v, beta = _reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= beta * np.outer(m[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= beta * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential qd step; None if ``shift`` exceeds the smallest value."""
    new_q, new_e, pivots = [], [], []
    d = q[0] - shift
    for i, above in enumerate(e):
        if d < 0:
            return None
        pivots.append(d)
        total = d + above
        ratio = q[i + 1] / total
        new_q.append(total)
        new_e.append(above * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    pivots.append(d)
    return [*new_q, d], new_e, pivots


def _values(q: list[float], e: list[float]) -> list[float]:
    """All values of one qd array, in no order."""
    found: list[float] = []
    blocks = [(q, e, 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        for _ in range(1000 + 200 * len(q)):
            while e and e[-1] <= _NEGLIGIBLE * (moved + q[-1]):
                found.append(moved + q[-1])
                q, e = q[:-1], e[:-1]
            if not e:
                found.append(moved + q[0])
                break
            cut = next((i for i, x in enumerate(e) if x <= _NEGLIGIBLE * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            q, e, pivots = _step(q, e, 0.0)
            least = min(pivots)
            if least <= 0.0:
                continue  # a value of zero comes out at the end
            # The pivots' inverses sum to those of the values: a bound from below that is never passed.
            bound = (1 - 4 * len(q) * _EPS) / sum(1.0 / x for x in pivots)
            for shift in (0.98 * least, bound):
                taken = _step(q, e, shift)
                if taken:
                    q, e, _ = taken
                    moved += shift
                    break
        else:
            raise ArithmeticError("qd iteration did not end")
    return found


def _twisted(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Refined ``values`` and unit directions (columns) of B'B, for B with diagonal ``a`` and ``b`` above."""
    size = len(a)
    d, low = a * a, b / a[:-1]
    tiny = np.maximum(values, d.max()) * 1e-300 + np.finfo(np.float64).tiny

    def pivot(x: np.ndarray) -> np.ndarray:
        return np.where(x == 0, tiny, x)

    for _ in range(3):
        count = len(values)
        down, up = np.empty((size - 1, count)), np.empty((size - 1, count))
        top, bottom = np.empty((size, count)), np.empty((size, count))
        top[0] = -values
        for i in range(size - 1):
            meet = pivot(top[i] + d[i])
            down[i] = d[i] * low[i] / meet
            top[i + 1] = down[i] * low[i] * top[i] - values
        bottom[-1] = d[-1] - values
        for i in range(size - 2, -1, -1):
            ratio = d[i] / pivot(d[i] * low[i] ** 2 + bottom[i + 1])
            up[i] = low[i] * ratio
            bottom[i] = bottom[i + 1] * ratio - values
        gamma = top + bottom + values
        at = np.abs(gamma).argmin(axis=0)
        z = np.zeros((size, count))
        z[at, np.arange(count)] = 1.0
        for i in range(size - 2, -1, -1):
            z[i] = np.where(i < at, -down[i] * z[i + 1], z[i])
        for i in range(size - 1):
            z[i + 1] = np.where(i >= at, -up[i] * z[i], z[i + 1])
        square = (z * z).sum(axis=0)
        values = np.maximum(values + gamma[at, np.arange(count)] / square, 0.0)  # the Rayleigh quotient
    return values, z / np.sqrt(square)


def _apart(z: np.ndarray, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Directions of nearly equal values made orthogonal; ``values`` fall.

    Where the twisted directions of such values do not span their space, inverse iteration
    from a random start finds the rest.
    """
    size = len(values)
    upper = np.diag(a) + np.diag(b, 1)
    rng = np.random.default_rng(0)
    first = 0

    def clear(v: np.ndarray, j: int) -> np.ndarray:
        for _ in range(2):
            v = v - z[:, first:j] @ (z[:, first:j].T @ v)
        return v

    for j in range(1, size):
        if values[j - 1] - values[j] > _CLOSE * values[j - 1]:
            first = j
            continue
        v = clear(z[:, j], j)
        if float(np.sqrt(v @ v)) < 1e-3:
            v = rng.normal(size=size)
            near = upper.T @ upper - np.eye(size) * (values[j] + 4 * _EPS * values[0])
            for _ in range(3):
                v = clear(v / np.sqrt(v @ v), j)
                v = np.linalg.solve(near, v)
            v = clear(v / np.sqrt(v @ v), j)
        z[:, j] = v / np.sqrt(v @ v)
    return z


def directions(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of an upper triangle, falling, and its right singular vectors as columns.

    Values below the rounding of the largest come with directions that only complete the
    others.
    """
    size = len(triangle)
    largest = np.abs(triangle).max(initial=0.0)
    if not largest:
        return np.zeros(size), np.eye(size)
    a, b, right = bidiagonal(triangle / largest)
    norm = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    # A zero on the diagonal has no inverse; this much is lost in the reflections anyhow.
    a = np.where(np.abs(a) < _EPS**2 * norm, _EPS**2 * norm, a)
    cuts = [0, *(np.flatnonzero(np.abs(b) <= _EPS * (np.abs(a[:-1]) + np.abs(a[1:])) / 4) + 1).tolist(), size]
    values, z = np.empty(size), np.zeros((size, size))
    for low, high in zip(cuts[:-1], cuts[1:]):
        qd = (a[low:high] ** 2).tolist(), (b[low : high - 1] ** 2).tolist()
        found = np.sort(np.array(_values(*qd)))[::-1]
        found, vectors = _twisted(a[low:high], b[low : high - 1], found)
        order = np.argsort(-found, kind="stable")
        values[low:high] = found[order]
        z[low:high, low:high] = _apart(vectors[:, order], found[order], a[low:high], b[low : high - 1])
    order = np.argsort(-values, kind="stable")
    return values[order] * float(largest) ** 2, right @ z[:, order]
