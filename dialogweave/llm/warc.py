"""WARC archives with individually compressed records and a shared Zstandard dictionary.

An archive is a sequence of Zstandard frames. The first is a skippable frame that holds the
dictionary; every record is a frame of its own, compressed with it. Archives are written by
Spark's text writer with the record's bytes as the line and an empty skippable frame as the
line separator: what it writes is a valid stream of frames, committed and retried by Spark
like any other output, on any file system that Spark reaches.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogweave.llm.common import shuffle_parts
from dialogweave.session import shared_folder

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
DATE = "1970-01-01T00:00:00Z"

SAMPLE_RECORDS = 400
SAMPLE_BYTES = 64 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 6


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample records; from few or short ones, their own content."""
    if sum(map(len, samples)) > 8 * 1024:
        try:
            return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples, k=1024, d=8).as_bytes()
        except zstandard.ZstdError:
            pass  # too few samples for the trainer
    return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the headers and leaves out the payload."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    address = "".join(c for c in (url or "") if c >= " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {address}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head.insert(6, f"WARC-Refers-To: {_name(refers_to)}")
        head.insert(6, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of one record and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def frames(stream: bytes) -> Iterator[tuple[int, bytes]]:
    """The skippable frames of a stream, as (magic, content), and the others, as (0, frame).
    Records carry their content size, so their end follows from decompression."""
    at = 0
    while at < len(stream):
        magic = int.from_bytes(stream[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = int.from_bytes(stream[at + 4 : at + 8], "little")
            yield magic, stream[at + 8 : at + 8 + size]
            at += 8 + size
        else:
            end = _frame_end(stream, at)
            yield 0, stream[at:end]
            at = end


def _frame_end(stream: bytes, at: int) -> int:
    """Where the frame at this place ends, by its block headers."""
    info = zstandard.get_frame_parameters(stream[at : at + 18])
    at += zstandard.frame_header_size(stream[at : at + 18])
    while True:
        head = int.from_bytes(stream[at : at + 3], "little")
        size = 1 if head >> 1 & 3 == 1 else head >> 3
        at += 3 + size
        if head & 1:
            return at + 4 * info.has_checksum


def resolved(pages: DataFrame, min_bytes: int) -> DataFrame:
    """pages with refers_to: the smallest page_id with an equal payload of ``min_bytes`` or
    more, NULL for that page itself. Digests are counted before they meet the pages."""
    pages = pages.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    large = pages.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull())
    twice = large.groupBy("sha").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    joined = pages.join(twice.select(F.col("sha").alias("twice"), "least"), F.col("sha") == F.col("twice"), "left")
    revisit = (F.col("least") < F.col("page_id")) & (F.octet_length("html") >= min_bytes)
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("least")).alias("refers_to"))


def write_archives(
    pages: DataFrame,
    path: str,
    min_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Writes one record per row of pages, in archives under ``path``.

    NULL html is an empty payload. Of records with equal payloads of ``min_bytes`` or more,
    that with the smallest id is the response; rows that repeat this id are responses too. A
    row with NULL id is a response. The dictionary is trained on SAMPLE_RECORDS records of
    SAMPLE_BYTES at most, the least by a hash of the id; without rows no archive has records.
    Other columns are not read.
    """
    pages = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    sample = pages.where(F.octet_length("html") <= SAMPLE_BYTES).orderBy(F.xxhash64("page_id"), "page_id")
    samples = [record(r["page_id"], r["url"], r["html"].encode(), None) for r in sample.limit(SAMPLE_RECORDS).collect()]
    trained = train_dictionary(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _dictionary(trained)
        if shared:
            shared.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True, write_content_size=True)
        started = False
        for batch in batches:
            out = []
            if not started and batch.num_rows:
                out.append(struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained)
                started = True
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(packer.compress(record(page, url, html.encode(), refers)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    lines = resolved(pages, min_bytes).mapInArrow(run, "frame binary")
    lines.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload), one row
    per record of the archives under ``path``; payload is NULL for revisits. A response whose
    payload does not match its digest or length fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column(0).to_pylist():
                reader, rows = None, []
                for magic, content in frames(stream):
                    if magic == DICTIONARY_FRAME:
                        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
                    elif not magic:
                        rows.append(_row(*parse(reader.decompress(content))))
                        if len(rows) == 256:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, _SCHEMA)


_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def _page(name: str | None) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">") if name else ""
    return int(number) if number else None


def _row(fields: dict[str, str], block: bytes) -> tuple:
    kind, size = fields["WARC-Type"], int(fields["X-Payload-Length"])
    marked = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (digest(block) != marked or len(block) != size):
        raise ValueError("a payload does not match its digest")
    payload = block if kind == "response" else None
    return (
        _page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, marked, kind,
        _page(fields.get("WARC-Refers-To")), payload,
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def archive_round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Writes the pages under ``path`` (a new shared folder by default) and reads them back."""
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    write_archives(pages, path, min_bytes, **columns)
    return read_archives(spark, path)
