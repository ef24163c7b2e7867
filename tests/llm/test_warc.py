"""WARC archives: round trip, revisits, and a plain reader for the format."""

from __future__ import annotations

import glob
import hashlib
from base64 import b32encode

import pytest
import zstandard

from airgauge.llm import warc
from airgauge.session import fresh_folder, ship_package
from tests.llm import cases

ROWS = [
    (1, "http://a/", "<p>same</p>"), (2, "http://b/ c", "<p>same</p>"), (5, None, "<p>same</p>"), (5, "x", "<p>same</p>"),
    (3, "u", None), (4, "u", ""), (None, "u", "null id"), (None, "u", "null id"), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 9),
    (8, "u", "long " * 400_000), *[(i, "u", f"<html>{'row ' * (i % 7)}{i}</html>") for i in range(20, 90)],
    *[(i, "u", "hot") for i in range(100, 140)],
]


def plain(rows, least=0):
    raw = [(page, (html or "").encode()) for page, _, html in rows]
    last: dict = {}
    for i, (page, payload) in enumerate(raw):
        if len(payload) >= least and (payload not in last or (page is not None, page or 0, i) > last[payload]):
            last[payload] = (page is not None, page or 0, i)
    out = []
    for i, (page, payload) in enumerate(raw):
        response = len(payload) < least or last[payload][2] == i
        digest = b32encode(hashlib.sha1(payload).digest()).decode()
        refers = None if response or not last[payload][0] else last[payload][1]
        out.append((page, len(payload), digest, "response" if response else "revisit", refers))
    return out


@pytest.mark.parametrize("least", [0, 10])
def test_hard_pages(spark, tmp_path, least):
    ship_package(spark)
    path = str(tmp_path / "pages.parquet")
    full = [(*r, "clash", "clash", "clash") for r in ROWS]
    spark.createDataFrame(full, "page_id bigint, url string, html string, digest string, place string, size string").repartition(3).write.parquet(path)
    pages = spark.read.parquet(path)
    got = warc.archived(pages, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert cases.in_order(got) == cases.in_order(plain(ROWS, least))
    assert warc.archived(pages.limit(0)).count() == 0


def test_files_are_plain_zstandard(spark, tmp_path):
    """Each file is a dictionary frame, frames of one record each, and a skippable frame at the end."""
    ship_package(spark)
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").coalesce(1)
    folder = fresh_folder(spark, "warc")
    warc.write_archives(pages, folder)
    texts = []
    for name in glob.glob(f"{folder.removeprefix('file:')}/part-*"):
        raw = open(name, "rb").read()
        assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC
        assert raw[-9:] == warc._TAIL + b"\n"
        size = int.from_bytes(raw[4:8], "little")
        extra = {"dict_data": zstandard.ZstdCompressionDict(raw[8 : 8 + size])} if size else {}
        at = 8 + size
        while at < len(raw) - 9:
            one = zstandard.ZstdDecompressor(**extra).decompressobj()
            texts.append(one.decompress(raw[at:]))
            at = len(raw) - len(one.unused_data)
    assert len(texts) == len(ROWS)
    for text in texts:
        headers, block = warc.parse(text)
        assert headers["warc-type"] in ("response", "revisit") and len(block) == int(headers["content-length"])


def test_dictionary_helps_small_records():
    records = [f"WARC/1.1 common header of all pages <html><body>{i * 7919}</body></html>".encode() for i in range(400)]
    packed = warc.archive(records) + b"\n"
    alone = sum(len(zstandard.compress(r)) for r in records)
    assert list(warc.records(packed)) == records and len(packed) < alone
    assert list(warc.records(packed + packed)) == records * 2


def test_a_cut_record_is_an_error():
    raw = warc.record(1, "u", b"payload", "D", None, False)
    with pytest.raises(ValueError):
        warc.parse(raw[:-5])


def test_short_and_large_archives_have_a_dictionary():
    """One record, a few, and more bytes than the sample holds."""
    for payloads in ([b"x" * 9], [b"<p>row</p>" * 3] * 5, [bytes([i % 251]) * 70_000 + str(i).encode() for i in range(90)]):
        made = [warc.record(i, "http://a/", x, warc.payload_digest(x), None, False) for i, x in enumerate(payloads)]
        data = warc.archive(made) + b"\n"
        size = int.from_bytes(data[4:8], "little")
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC and 0 < size <= warc.DICTIONARY_BYTES
        assert list(warc.records(data)) == made
    assert list(warc.records(warc.archive([]) + b"\n")) == []
