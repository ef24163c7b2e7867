"""Token ids, packing and token files, against the tokenizer itself."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from airgauge.llm import blocks, packing
from airgauge.llm.queries import QUERIES, tokenizer_path
from airgauge.llm.tokens import PieceEncoder, encoder
from airgauge.session import fresh_folder, ship_package
from tests.llm import cases

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def encoded(texts):
    ids, bounds = encoder(tokenizer_path()).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_hard_texts(tokenizer):
    texts = [t for _, t in cases.hard_texts()] + ["Don't <|ENDOFTEXT|> <|endoftext|>", "ΑΣ ς İ ǅ", " ́a é.", "x" * 9000, "a.b,,c;d9"]
    assert encoded(texts) == [plain_ids(tokenizer, t)[:-1] for t in texts]
    assert encoded([]) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abÉé́<|>endoftx'sS12.,;— \n\t\x0bİΣß日"), max_size=40), max_size=4))
def test_any_texts(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert encoded(texts) == [plain_ids(tokenizer, t)[:-1] for t in texts]


def test_other_tokenizers_get_whole_texts():
    """A file that keeps case and white space is not cut into pieces."""
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = PieceEncoder(path)
    assert PieceEncoder(public_tokenizers.path("word_bpe_49k.json")).by_pieces and not other.by_pieces
    texts = [t for _, t in cases.hard_texts()[:14]] + ["  Two  Spaces\n", "it's <|endoftext|>"]
    ids, bounds = other.encode(pa.array(texts, pa.string()))
    plain = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids
    assert other.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_a_full_store_changes_nothing(monkeypatch, tokenizer):
    monkeypatch.setattr("airgauge.llm.tokens._IDS", 50)
    small, rng = PieceEncoder(tokenizer_path()), random.Random(2)
    for _ in range(4):
        texts = [cases.sentence(rng, 40) for _ in range(5)]
        ids, bounds = small.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [plain_ids(tokenizer, t)[:-1] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.integers(0, 12))
def test_assignment(lengths, sequences):
    placed = packing.assign(np.array(lengths, np.int64), sequences, 64)
    parts, filled = defaultdict(list), Counter()
    for item, start, length, sequence in placed:
        parts[item].append((start, length))
        if sequence >= 0:
            filled[sequence] += length
        else:  # only what no sequence has room for is left over
            assert sum(filled.values()) == 64 * sequences
    for item, length in enumerate(lengths):
        at = 0
        for start, size in parts[item]:
            assert start == at
            at += size
        assert at == length
    assert all(x <= 64 for x in filled.values())


def test_costs_are_balanced():
    rng = random.Random(4)
    lengths = np.array([rng.randint(10, 900) for _ in range(400)])
    cost = np.zeros(40)
    for _, _, length, sequence in packing.assign(lengths, 60, 4096):
        if sequence < 40:
            cost[sequence] += length + length**2 / 2048
    assert cost.max() < 1.3 * cost.min()


def check_pieces(pieces, ids):
    """Each id of each document lies in one piece; sequences have no gap and little padding."""
    wanted, got = Counter(), defaultdict(list)
    for doc_id, x in ids:
        wanted[(doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))] += 1
    sequences = defaultdict(list)
    for p in pieces:
        got[(p.doc_id, p.doc_tokens)].append((p.start, bytes(p.ids)))
        assert len(p.ids) == 4 * p.length and p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length, p.sequence_length))
    for rows in sequences.values():
        at = 0
        for offset, length, whole in sorted(rows):
            assert offset == at
            at += length
        assert at == whole <= 4096 and whole & (whole - 1) == 0
    found = Counter()
    for (doc_id, tokens), parts in got.items():
        at, raw = Counter(), sorted(parts)
        copies = sum(len(x) for _, x in raw) // (4 * tokens)
        assert sum(len(x) for _, x in raw) == 4 * tokens * copies
        if copies == 1:
            found[(doc_id, tokens, zlib.crc32(b"".join(x for _, x in raw)))] += 1
        else:  # repeated rows: pieces of each cover the document once
            for start, x in raw:
                at.update(range(start, start + len(x) // 4))
            assert set(at.values()) == {copies} and len(at) == tokens
            text = np.zeros(tokens, "<u4")
            for start, x in raw:
                text[start : start + len(x) // 4] = np.frombuffer(x, "<u4")
            found[(doc_id, tokens, zlib.crc32(text.tobytes()))] += copies
    assert found == wanted


def test_packing_of_hard_documents(spark, tokenizer, tmp_path):
    ship_package(spark)
    rows = cases.hard_texts()
    docs = cases.stored(spark, tmp_path, rows)
    ids = [(d, plain_ids(tokenizer, t)) for d, t in rows]
    check_pieces(packing.pack(docs, tokenizer_path()).collect(), ids)
    check_pieces(packing.pack(docs, tokenizer_path(), window_tokens=5000).collect(), ids)
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_packing_query(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    known = {d.doc_id: plain_ids(tokenizer, d.text) for d in docs}
    pieces = QUERIES["op1_packing"](spark, FOLDER).collect()
    assert Counter({d: len(x) for d, x in known.items()}) == sum(
        (Counter({p.doc_id: p.length}) for p in pieces), Counter()
    )
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(known[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_000), st.just(7), st.integers(0, 2**32 - 1)), max_size=900), st.integers(0, 900), st.integers(0, 900))
def test_blocks_round_trip(values, low, high):
    ids = np.array(values, np.uint32)
    payload, starts = blocks.encode_blocks(ids)
    if len(ids):
        assert blocks.decode_blocks(payload, starts).ravel()[: len(ids)].tolist() == values
    raw = blocks.encode_segment(3, 4, [None, 5], np.array([0, len(ids)]), ids) + b"\n"
    (segment,) = blocks.segments(raw)
    assert (segment.part, segment.number, segment.doc_ids, segment.sizes.tolist()) == (3, 4, [None, 5], [0, len(ids)])
    assert segment.ids(low, high).tolist() == values[low:high]


def test_a_damaged_file_is_an_error():
    raw = blocks.encode_segment(0, 0, [1], np.array([3]), np.array([1, 2, 3], np.uint32)) + b"\n"
    with pytest.raises(ValueError):
        list(blocks.segments(b"\0" + raw[1:]))


def test_token_files_of_hard_documents(spark, tokenizer, tmp_path):
    ship_package(spark)
    rows = cases.hard_texts()
    docs = cases.stored(spark, tmp_path, rows)
    folder = fresh_folder(spark, "tokens")
    blocks.write_token_files(docs, tokenizer_path(), folder, segment_tokens=4000)
    got = blocks.read_token_files(spark, folder).collect()
    ordered = sorted(got, key=lambda r: (r.part, r.number, r.at))
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter(
        (d, np.array(plain_ids(tokenizer, t), "<u4").tobytes()) for d, t in rows
    )
    assert len({r.number for r in got}) > 1
    digests = blocks.token_digests(docs, tokenizer_path()).orderBy("start").collect()
    at = 0
    for r in digests:
        assert r.start == at
        at += r.n_tokens
    assert len(digests) == len(rows)
    assert blocks.token_digests(docs.limit(0), tokenizer_path()).count() == 0


def test_token_files_query(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, at = [], 0
    for d in docs:
        x = plain_ids(tokenizer, d.text)
        want.append((d.doc_id, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    got = QUERIES["op8_token_files"](spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == want
