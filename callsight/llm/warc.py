"""WARC archives: one gzip member per record, written by many tasks, read by byte ranges.

Writing: payloads of at least MIN_REVISIT bytes that are equal are stored once, with the
smallest page_id; the others become revisit records that name it. Each task writes archives
of its own below the given folder, under a name that no other attempt uses, and reports them;
only reported files are read, so a lost executor leaves at most an unread file behind.

Reading: an archive is cut into byte ranges, one task a range. A task looks for the gzip
magic, decodes the header of a candidate member and takes it for a record only if it inflates
to a WARC version line; it owns the records that start inside its range and reads the last
one past the range's end. So any cut gives every record exactly once.

Defined cases: a null html is an empty payload, a null url leaves the target out, a null
page_id leaves the number out of the record id and reads back as null; rows that repeat a
page_id are records of their own, and all that have the smallest one are responses; an empty
table gives no archive and no record. Control characters in a URL are percent-encoded. Extra
columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.llm.common import kept, text_bytes

MIN_REVISIT = 100
ARCHIVE_BYTES = 1 << 30
SPLIT_BYTES = 64 << 20
READ_BYTES = 1 << 20
PIECE_BYTES = 1 << 15  # inflated at a time
BATCH_BYTES = 8 << 20
LEVEL = 4

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
ID = "urn:page:"


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (the response's page_id, for revisits)."""
    rows = pages.select("page_id", "url", text_bytes("html").alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    large = F.octet_length("payload") >= MIN_REVISIT
    first = (
        rows.where(large & F.col("page_id").isNotNull())
        .groupBy(F.col("digest").alias("of"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("times"))
        .where("times > 1")
    )
    return rows.join(first, large & (F.col("digest") == F.col("of")), "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to"),
    )


def _clean(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, not yet compressed."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{ID}{refers_to}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark would read it: the cluster's own where none is named."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a qualified path, and the path in it."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pa.fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; returns path, bytes, records of each (a kept table)."""
    folder = qualified(pages.sparkSession, folder).rstrip("/")

    def archives(batches):
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        out = path = None
        done, count = [], 0
        try:
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if out is None:
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        path = f"{folder}/{name}"
                        out, count = fs.open_output_stream(f"{base}/{name}", compression=None), 0
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    out.write(packer.compress(record(*row)) + packer.flush())
                    count += 1
                    if out.tell() >= archive_bytes:
                        done.append((path, out.tell(), count))
                        out.close()
                        out = None
            if out is not None:
                done.append((path, out.tell(), count))
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("path", "bytes", "records"), d, strict=True)) for d in done],
            schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]),
        )

    listed = with_types(pages).mapInArrow(archives, "path string, bytes long, records long")
    return kept(listed, "warc-files")


def headers(head: bytes) -> dict[str, str] | None:
    """The named fields of a record's header, or None if it is none."""
    if not head.startswith(VERSION):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


class _Range:
    """Bytes of a file from `start` on, which lies at `at` in `data`; what lies behind is let go now and then."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data, self.at = file, start, bytearray(), 0
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(READ_BYTES)
        self.data += got
        return bool(got)

    def drop(self, count: int) -> None:
        self.at += count
        self.start += count
        if self.at > READ_BYTES:
            del self.data[: self.at]
            self.at = 0


def member(source: _Range) -> tuple[bytes, int] | None:
    """The record whose member begins at the source's start and the member's size, or None."""
    unpacker = zlib.decompressobj(31)
    parts: list[bytes] = []
    got, at = 0, source.at
    while not unpacker.eof:
        piece = source.data[at : at + PIECE_BYTES]
        if not piece:
            if not source.more():
                return None
            continue
        try:
            part = unpacker.decompress(piece)
        except zlib.error:
            return None
        at += len(piece)
        parts.append(part)
        if got < len(VERSION):
            start = b"".join(parts)[: len(VERSION)]
            if not VERSION.startswith(start):
                return None
        got += len(part)
    return (b"".join(parts), at - len(unpacker.unused_data) - source.at) if got >= len(VERSION) else None


def records_of(file, start: int, end: int):
    """(offset, fields, block) of the records that start in [start, end)."""
    source = _Range(file, start)
    while source.start < end:
        at = source.data.find(MAGIC, source.at)
        if at < 0:
            source.drop(max(0, len(source.data) - source.at - len(MAGIC) + 1))
            if not source.more():
                return
            continue
        source.drop(at - source.at)
        if source.start >= end:
            return
        found = member(source)
        fields = None
        if found:
            head, _, rest = found[0].partition(b"\r\n\r\n")
            fields = headers(head)
        if fields is None:
            source.drop(1)
            continue
        yield source.start, fields, rest[: int(fields["content-length"])]
        source.drop(found[1])


def _number(record_id: str | None) -> int | None:
    digits = (record_id or "").removeprefix(f"<{ID}").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("url", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("path", pa.string()),
        ("offset", pa.int64()),
    ]
)
RECORD_DDL = (
    "page_id long, record_type string, url string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, path string, offset long"
)


def parse(path: str, offset: int, fields: dict[str, str], block: bytes) -> dict:
    """A record's row. The size and digest of a revisit are those that its headers give;
    those of a response are taken from the payload as read."""
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    size = next(
        (int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), 0
    )
    return {
        "page_id": _number(fields.get("warc-record-id")),
        "record_type": fields["warc-type"],
        "url": fields.get("warc-target-uri"),
        "refers_to": _number(fields.get("warc-refers-to")),
        "payload_bytes": size if revisit else len(payload),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:")
        if revisit
        else hashlib.sha256(payload).hexdigest(),
        "payload": None if revisit else payload,
        "path": path,
        "offset": offset,
    }


def read(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of `files` (path, bytes), by ranges of `split_bytes`. Paths may leave the file system out."""
    root = qualified(spark, "/").rstrip("/")

    def scan(batches):
        for batch in batches:
            for path, start, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, at = _filesystem(path if ":" in path.partition("/")[0] else f"{root}{path}")
                rows, held = [], 0
                with fs.open_input_file(at) as file:
                    for offset, fields, block in records_of(file, start, end):
                        rows.append(parse(path, offset, fields, block))
                        held += len(block)
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=RECORD)

    ranges = (
        files.where("bytes > 0")
        .select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("start"))
        .select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    )
    tasks = max(1, files.agg(F.sum(F.expr(f"ceil(bytes / {split_bytes})"))).first()[0] or 1)
    return ranges.repartition(int(tasks)).mapInArrow(scan, RECORD_DDL)
