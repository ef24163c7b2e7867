"""Token ids of whole texts by a given tokenizer file, with each distinct piece encoded once.

The word tokenizer works on pieces that never cross white space, so a text's ids
are the ids of its pieces in order. A piece of ASCII letters, digits and signs is
cut further where these kinds meet, as the tokenizer itself does there; anything
else (with an apostrophe, ``<`` or a longer character) stays whole up to the next
white space. Novel pieces of letters go to the tokenizer's model, all other ones
to the whole tokenizer. A tokenizer that prepares its texts in any other way is asked for
whole texts.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import pyarrow as pa

from airgauge.llm.bytewise import byte_class, hashes, joined, per_text, ragged

#: White space for every engine; rarer kinds stay inside a piece.
_BLANK = byte_class((0x20, 0x20), (0x09, 0x0A), (0x0D, 0x0D))
_SIGN = byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x3B), (0x3D, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_OTHER = 4
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[_BLANK] = 0
_KIND[byte_class((0x41, 0x5A), (0x61, 0x7A))] = 1
_KIND[byte_class((0x30, 0x39))] = 2
_KIND[_SIGN] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters that are one character in every normal form.
_LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]*)")
_SLOTS = 1 << 22
_IDS = 1 << 24  # kept ids; beyond that the store is emptied, which changes no result


# How a tokenizer file says that it lower-cases texts and cuts them into words as above.
_NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CUTS = [
    {"type": "Split", "pattern": {"Regex": _WORD_PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def works_on_words(tokenizer) -> bool:
    """Whether a text's ids are those of its pieces in order, so that pieces may be encoded one by one."""
    said = json.loads(tokenizer.to_str())
    return (
        (said["normalizer"] or {}).get("normalizers") == _NORMALIZER
        and (said["pre_tokenizer"] or {}).get("pretokenizers") == _CUTS
        and said["post_processor"] is None
        and said["model"].get("end_of_word_suffix") is not None
        and not any(x["normalized"] or x["lstrip"] or x["rstrip"] for x in said["added_tokens"])
    )


class PieceEncoder:
    """Encodes batches of texts; keeps the ids of the pieces that it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.by_pieces = works_on_words(self._tokenizer)
        # Byte-level models see each byte as a visible character, numbered on from 256 where it has none.
        seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [x for x in range(256) if x not in seen]
        self._visible = {x: 256 + n for n, x in enumerate(hidden)}
        self._empty()

    def _empty(self) -> None:
        self._keys = np.zeros(_SLOTS, np.uint64)
        self._starts, self._lengths = np.zeros(_SLOTS, np.int32), np.zeros(_SLOTS, np.int32)
        self._ids, self._used = np.zeros(1 << 20, np.uint32), 0

    def _piece(self, raw: bytes) -> list[int]:
        if raw.isalpha():  # ASCII letters only, as these are bytes
            return [x.id for x in self._tokenizer.model.tokenize(raw.decode())]
        text = raw.decode("utf-8", "replace")
        if match := _LATIN.fullmatch(text):
            word = match[1].lower().encode().decode("latin-1").translate(self._visible)
            ids = [x.id for x in self._tokenizer.model.tokenize(word)]
            return ids + self._piece(match[2].encode()) if match[2] else ids
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _add(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Store the ids of new pieces; their places and lengths."""
        ids = list(map(self._piece, pieces))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = self._used + np.cumsum(lengths)
        last = int(ends[-1])
        while last > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : last] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, last - self._used)
        self._used = last
        return ends - lengths, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one text after the other, and where each text's ids begin and the last end."""
        if not self.by_pieces:
            return self._encode_whole(texts)
        if self._used > _IDS:
            self._empty()
        data, text_starts, _ = joined(texts)
        kind = _KIND[data]
        # Every text is followed by a line feed, so a piece never runs into the next text.
        before = np.empty_like(kind)
        before[:1], before[1:] = 0, kind[:-1]
        turns = np.flatnonzero(kind != before)
        here, prior = kind[turns], before[turns]
        chunk = np.flatnonzero(prior == 0)  # turns at which a run without white space begins
        other = np.add.reduceat(here == _OTHER, chunk, dtype=np.int32) > 0 if len(chunk) else np.zeros(0, bool)
        whole = np.repeat(other, np.diff(np.append(chunk, len(turns))))
        cut = ~whole | (prior == 0)
        starts, ends = turns[(here > 0) & cut], turns[(prior > 0) & (~whole | (here == 0))]
        lowered = _LOWER[data]
        if len(marks := np.flatnonzero(data == 0x3C)):  # names of special tokens keep their case
            first, last = turns[chunk], np.append(turns[chunk[1:] - 1], turns[-1])
            for i in np.unique(np.searchsorted(first, marks, "right") - 1).tolist():
                lowered[first[i] : last[i]] = data[first[i] : last[i]]
        keys = hashes(lowered, starts, ends)
        slots = (keys & np.uint64(_SLOTS - 1)).astype(np.int64)
        place, length = self._starts[slots].astype(np.int64), self._lengths[slots].astype(np.int64)
        lost = np.flatnonzero(self._keys[slots] != keys)
        if len(lost):
            new, first, back = np.unique(keys[lost], return_index=True, return_inverse=True)
            at = lost[first]
            raw = lowered.tobytes()
            new_place, new_length = self._add([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            place[lost], length[lost] = new_place[back], new_length[back]
            self._keys[slots[at]], self._starts[slots[at]], self._lengths[slots[at]] = new, new_place, new_length
        ids = self._ids[ragged(place, length)]
        bounds = np.concatenate([[0], np.cumsum(length)])
        return ids, bounds[per_text(starts, text_starts)]


    def _encode_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self._tokenizer.encode_batch([x or "" for x in texts.to_pylist()], add_special_tokens=False)
        ids = [np.array(x.ids, np.uint32) for x in found]
        bounds = np.cumsum([0, *map(len, ids)])
        return np.concatenate([np.zeros(0, np.uint32), *ids]), bounds


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process."""
    return PieceEncoder(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, each followed by ``end_id``."""
    texts = len(bounds) - 1
    out = np.insert(ids, bounds[1:], np.uint32(end_id))
    return out, bounds + np.arange(texts + 1)
