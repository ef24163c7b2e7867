"""License scan: windows of texts compared to license templates by Dice coefficient over word bigrams.

For every template the window of its length that holds most of its bigrams is found from
the positions of shared bigrams, wherever it lies: lines, paragraphs, comment marks and
carriage returns play no part, as they are no words. Two sets of a and b bigrams have a Dice coefficient
of 2 * common / (a + b), which cannot reach ``least`` unless they share least / (2 - least) as many as
the template has, so all other windows are passed over before any set is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgauge.llm.bytewise import ALPHANUMERIC, batches_by_bytes, mixed, ragged, word_hashes
from airgauge.llm.license_templates import templates as known_templates

LEAST = (8, 10)


def _bigrams(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


@dataclass
class Templates:
    names: list[str]
    sizes: np.ndarray  # distinct bigrams
    spans: np.ndarray  # all bigrams
    bigrams: np.ndarray  # sorted, distinct
    owners: np.ndarray  # templates of each bigram, one after the other
    bounds: np.ndarray

    @classmethod
    def of(cls, texts: dict[str, str]) -> Templates:
        """Templates in the order of their names; those of one word or none match nothing."""
        names = sorted(texts)
        words = [word_hashes(pa.array([texts[name]]), ALPHANUMERIC)[0] for name in names]
        sets = [np.unique(_bigrams(w)) for w in words]
        pairs = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.lexsort(pairs[::-1])
        bigrams, first = np.unique(pairs[0][order], return_index=True)
        return cls(
            names,
            np.array([len(x) for x in sets], np.int64),
            np.array([max(len(w) - 1, 0) for w in words], np.int64),
            bigrams,
            pairs[1][order],
            np.append(first, len(order)).astype(np.int64),
        )


def _windows(
    text: np.ndarray, last: np.ndarray, at: np.ndarray, owner: np.ndarray, spans: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best window of each text and template: (text, template, start, end, shared bigrams in it).

    ``at`` are places of bigrams that the template ``owner`` has. A window begins at one of
    them, spans as many bigrams as the template, and ends with its text at the latest.
    """
    order = np.lexsort((at, owner))
    at, owner, text = at[order], owner[order], text[order]
    ends = np.minimum(at + spans[owner], last[text])
    room = int(last.max(initial=0)) + 1
    shared = np.searchsorted(owner * room + at, owner * room + ends) - np.arange(len(at))
    first = np.flatnonzero(np.diff(owner, prepend=-1).astype(bool) | np.diff(text, prepend=-1).astype(bool))
    most = np.repeat(np.maximum.reduceat(shared, first), np.diff(np.append(first, len(at))))
    full = np.flatnonzero(shared == most)
    best = full[np.searchsorted(full, first)]
    return text[best], owner[best], at[best], ends[best], shared[best]


NO_LICENSE = (0, None, None, None, None, None)


def scan(texts: pa.Array, templates: Templates, least: tuple[int, int]) -> list[tuple]:
    """(compared, license, template, common, total, word) of each text: its best template if one is similar enough."""
    num, den = least
    words, first = word_hashes(texts, ALPHANUMERIC)
    count = len(first) - 1
    found: list[tuple] = [NO_LICENSE] * count
    if len(words) < 2 or not len(templates.bigrams):
        return found
    pairs = _bigrams(words)
    place = np.minimum(np.searchsorted(templates.bigrams, pairs), len(templates.bigrams) - 1)
    hit = templates.bigrams[place] == pairs
    inner = first[1:-1]
    hit[inner[(inner > 0) & (inner < len(words))] - 1] = False  # one word in each of two texts
    at = np.flatnonzero(hit)
    if not len(at):
        return found
    many = templates.bounds[place[at] + 1] - templates.bounds[place[at]]
    owner = templates.owners[ragged(templates.bounds[place[at]], many)]
    at = np.repeat(at, many)
    text = np.searchsorted(first, at, "right") - 1
    last = np.maximum(first[1:] - 1, first[:-1])  # bigrams of a text end before this place
    text, owner, start, end, shared = _windows(text, last, at, owner, templates.spans)
    able = shared * (2 * den - num) >= num * templates.sizes[owner]
    best: dict[int, tuple] = {}
    for t, o, low, high in zip(*(x[able].tolist() for x in (text, owner, start, end))):
        window = np.unique(pairs[low:high])
        near = np.minimum(np.searchsorted(templates.bigrams, window), len(templates.bigrams) - 1)
        near = near[templates.bigrams[near] == window]
        steps = templates.bounds[near + 1] - templates.bounds[near]
        common = int((templates.owners[ragged(templates.bounds[near], steps)] == o).sum())
        total = len(window) + int(templates.sizes[o])
        if 2 * den * common >= num * total:
            key = (-common / total, -total, templates.names[o])
            if t not in best or key < best[t][0]:
                best[t] = (key, common, total, low - int(first[t]))
    compared = np.bincount(text[able], minlength=count)
    for t in np.flatnonzero(compared).tolist():
        row = (None,) * 5
        if t in best:
            (_, _, name), common, total, word = best[t]
            row = (name.split()[0], name, common, total, word)
        found[t] = (int(compared[t]), *row)
    return found


FOUND = (
    "doc_id bigint, compared bigint, license string, template string, common bigint, total bigint, word bigint"
)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: tuple[int, int] = LEAST) -> DataFrame:
    """The most similar license template of every document (doc_id, text), if its Dice is ``least`` or more.

    Words are runs of digits, letters and longer characters, in lower case, so punctuation,
    line ends of any kind and comment marks do not matter. For each template the first of
    the windows that hold most of its bigrams (with repeats) is looked at. ``compared`` counts
    the templates that the size bounds leave; the Dice coefficient is 2 * ``common`` /
    ``total``; ``word`` is the number of words before the window. Ties go to the larger total,
    then to the template named first. Texts that are null, empty or of one word match
    nothing; repeated rows are scanned each; other columns are ignored. Nothing is shuffled.
    """
    known = Templates.of(known_templates() if templates is None else templates)
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", 1 << 20):
            found = scan(batch.column("text"), known, least)
            columns = [pa.array(list(x), kind) for x, kind in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, FOUND)
