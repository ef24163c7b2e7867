"""WARC archives with a Zstandard dictionary in front and one frame for each record.

An archive is a leading skippable frame (magic 0x184D2A5D) that holds the dictionary,
then one frame for each record, compressed with it. The dictionary is built from records
that are spread over the archive, up to a bounded number of bytes. After every part that
Spark's text writer puts down comes its line feed, which each part ends in as the one
byte of a skippable frame, so an archive is a plain sequence of Zstandard frames.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgauge.llm.bytewise import batches_by_bytes
from airgauge.session import broadcast_if_small, fresh_folder, settle

DICTIONARY_MAGIC = 0x184D2A5D
#: A skippable frame of one byte, which the writer's line feed fills.
_TAIL = (0x184D2A50).to_bytes(4, "little") + (1).to_bytes(4, "little")
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20  # of an archive's records, that its dictionary is trained on
SAMPLE_RECORD_BYTES = 64 << 10  # of one of them
ARCHIVE_BYTES = 16 << 20  # payload in an archive, before compression
LEVEL = 3
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record; a revisit holds headers only."""
    block = b"" if revisit else payload
    name = uuid.uuid5(_NAMES, f"{page_id}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join((url or 'about:blank').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_NAMES, f'{refers_to}')}>",
            f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}",
        ]
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)}
    size = int(headers["content-length"])
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return headers, rest[:size]


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES):
    """A dictionary of at most ``size`` bytes; None if there are no records.

    It is trained on a bounded sample: the records at every n-th place, n the smallest that gives
    about ``sample`` bytes, and of each no more than ``SAMPLE_RECORD_BYTES``. Records too few or too
    small to train on are its content as they are. The sample decides about sizes only;
    every record is written whole.
    """
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // sample))
    chosen = [x[:SAMPLE_RECORD_BYTES] for x in records[::step]]
    if not chosen:
        return None
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, chosen)) // 8)), chosen)
    except zstandard.ZstdError:
        content = b"".join(chosen)[-size:]
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive, without the line feed that closes it."""
    import zstandard

    dictionary = build_dictionary(records)
    raw = dictionary.as_bytes() if dictionary else b""
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
    head = DICTIONARY_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
    return b"".join([head, *map(compressor.compress, records), _TAIL])


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive file, which may be several archives one after the other."""
    import zstandard

    view, at, decompressor = memoryview(data), 0, None
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == DICTIONARY_MAGIC:
                raw = bytes(view[at + 8 : at + 8 + size])
                extra = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
                decompressor = zstandard.ZstdDecompressor(**extra)
            at += 8 + size
            continue
        reader = decompressor.decompressobj()
        yield reader.decompress(view[at:])
        at = len(view) - len(reader.unused_data)


def with_digests(pages: DataFrame) -> DataFrame:
    """(page_id, digest, place, size): the payload's SHA-1 and bytes, without the payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    return pages.select("page_id", "place", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives in ``folder``.

    Of records with equal payloads of at least ``least`` bytes, that of the largest
    page_id (of the last place, if rows repeat) is a response and the others revisit it.
    The largest is found by combining before the shuffle, and payloads stay with their
    rows or are dealt by the row's place, so a payload that most pages share meets in no task. Null html is empty;
    null page ids sort first; an empty table gives no record; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches_by_bytes(batches, "html", 4 << 20):
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                held.append(
                    record(row["page_id"], row["url"], payload, payload_digest(payload), row["refers_to"], row["revisit"])
                )
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([archive(held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"archive": pa.array([archive(held)], pa.binary())})

    rows = pages.select(
        F.col("page_id").cast("bigint"),
        F.col("url").cast("string"),
        F.col("html").cast("string"),
        F.monotonically_increasing_id().alias("place"),
    )
    digests = settle(with_digests(rows))
    last = F.max(F.struct("page_id", "place"))
    shared = (
        digests.where(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(last.alias("last"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "size", "last")
    )
    revisits = (
        digests.join(shared, ["digest", "size"])
        .where(F.col("place") != F.col("last.place"))
        .select("place", F.col("last.page_id").alias("refers_to"), F.lit(True).alias("revisit"))
    )
    # Payloads stay where they are if the revisits are few enough to be sent to them.
    known = rows.join(broadcast_if_small(settle(revisits)), "place", "left").withColumn("revisit", F.coalesce("revisit", F.lit(False)))
    (
        known.select("page_id", "url", "html", "refers_to", "revisit")
        .mapInArrow(run, "archive binary")
        .select(F.col("archive").cast("string"))
        .write.option("maxRecordsPerFile", 1)
        .text(folder)
    )


RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the archives; a revisit's payload is null."""

    def number(text: str) -> int | None:
        return int(text) if text else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def rows(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*held), kinds)], names)

        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for raw in records(content.as_py()):
                    headers, block = parse(raw)
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    response = headers["warc-type"] == "response"
                    if response and (payload_digest(block) != digest or len(block) != int(headers["x-payload-length"])):
                        raise ValueError(f"payload of page {headers['x-page-id']} is damaged")
                    held.append(
                        (
                            number(headers["x-page-id"]),
                            int(headers["x-payload-length"]),
                            digest,
                            headers["warc-type"],
                            number(headers.get("x-refers-to-page-id", "")),
                            headers["warc-target-uri"],
                            block if response else None,
                        )
                    )
                    size += len(block)
                    if size > 4 << 20:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORDS)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read their records back."""
    folder = fresh_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, least)
    return read_archives(pages.sparkSession, folder)
