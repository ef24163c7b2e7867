"""Words and hashes of whole batches of texts, on their UTF-8 bytes in numpy.

All word rules of this package are classes of ASCII bytes, and every byte of a
longer character is 0x80 or above, so texts need no decoding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ROOM = 1 << 20  # bytes hashed at a time
_FACTOR = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true in the given ranges (ends included)."""
    flags = np.zeros(256, bool)
    for low, high in ranges:
        flags[low : high + 1] = True
    return flags


#: Everything but the six ASCII white-space bytes.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, lower-case letters and all bytes of longer characters.
ALPHANUMERIC = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def batches_by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(lengths, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(low, high - low)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with a line feed after each text, and where each text starts and ends; null is empty."""
    parts = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    parts.append(b"")
    ends = np.cumsum(lengths + 1) - 1
    return np.frombuffer(b"\n".join(parts), np.uint8), ends - lengths, ends


def spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ``inside`` (a table of 256 flags) holds."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = inside[data]
    edges = np.flatnonzero(np.diff(flags))
    return edges[::2], edges[1::2]


def per_text(starts: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions in ``starts`` at which the spans of each text begin, and their number at the end."""
    return np.append(np.searchsorted(starts, text_starts), len(starts))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < size:
        size = max(size, _ROOM + 1)
        for name, factor in (("up", _FACTOR), ("down", pow(_FACTOR, -1, 1 << 64))):
            table = np.full(size, factor, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span lies."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _ROOM, "right")))
        first, last = int(starts[low]), int(ends[high - 1])
        up, down = _power_tables(last - first + 1)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_TABLE[data[first:last]] * up[: last - first], out=sums[1:])
        s, e = starts[low:high] - first, ends[low:high] - first
        out[low:high] = (sums[e] - sums[s]) * down[s]
        low = high
    return mixed(out)


def word_hashes(texts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and where each text's words begin."""
    data, text_starts, _ = joined(texts)
    data = LOWER[data]
    starts, ends = spans(data, inside)
    return hashes(data, starts, ends), per_text(starts, text_starts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
