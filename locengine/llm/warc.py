"""WARC archives: a writer and a salvage reader.

The writer makes archives of one gzip member per record. Of records with equal payloads of at
least `least` bytes the one with the largest id is a response, the others revisit it;
smaller payloads are all responses. Archives are limited in size and written by Spark's
own file writer, so any store that Spark reaches will do.

The reader checks each member's checksum, the record's version line, headers, length and
end, and the digest of its block. Where a check fails it searches for the next place at which a
whole valid record starts, a gzip member or a plain version line, goes on there, and logs
the gap with its reason. Line ends and zero bytes between records are padding, not gaps.

Null payloads are empty. Rows of the same id as the response are responses too. An empty table
writes an archive folder without records. Archives are read whole, one at a time: they are to
be of a size that a task can hold; Spark's own limit is 2 GB.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from locengine.config import materialise

ARCHIVE_BYTES = 8 << 20
_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/(?:0\.1[78]|1\.[01])\r\n")
_PAD = re.compile(rb"[\r\n\x00]*")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int
    end: int = 0


@dataclass
class Gap:
    offset: int
    end: int
    reason: str


class Damaged(ValueError):
    pass


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [*(f"{k}: {v}" for k, v in headers.items()), f"WARC-Block-Digest: {_digest(block)}"]
    lines.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    """A gzip member without a time, so that equal records give equal bytes."""
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    return coder.compress(raw) + coder.flush()


def parse(raw: bytes, at: int) -> Record:
    """The record that starts at a byte position, checked."""
    version = _VERSION.match(raw, at)
    if not version:
        raise Damaged("no version line")
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("headers do not end")
    headers: dict[str, str] = {}
    name = ""
    for line in raw[version.end() : stop].split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:
            headers[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        key, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("bad header line")
        name = key.strip().lower()
        headers[name] = value.strip()
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Damaged("no length")
    first = stop + 4
    end = first + int(length)
    if raw[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the block does not end where its length says")
    block = raw[first:end]
    want = headers.get("warc-block-digest", "")
    if want.lower().startswith("sha1:") and want[5:] != _digest(block)[5:]:
        raise Damaged("block digest differs")
    return Record(headers, block, at, end + 4)


def inflate(raw: bytes, at: int, most: int) -> tuple[bytes, int]:
    """A gzip member's content and end; its checksum and length are checked."""
    coder = zlib.decompressobj(31)
    parts, size, view = [], 0, memoryview(raw)
    while not coder.eof:
        piece = view[at : at + 65536]
        if not piece:
            raise Damaged("the member is cut off")
        try:
            got = coder.decompress(piece)
        except zlib.error as error:
            raise Damaged(f"gzip: {error}") from None
        at += len(piece)
        size += len(got)
        if size > most:
            raise Damaged("the member is too large")
        parts.append(got)
    return b"".join(parts), at - len(coder.unused_data)


def _plain(raw: bytes, at: int, end: int, gzip_too: bool, most: int) -> Iterator[Record | Gap]:
    """Records and gaps of raw[at:end]."""
    gap, reason = None, ""
    while True:
        at = _PAD.match(raw, at).end()
        if at >= end:
            break
        try:
            if gzip_too and raw.startswith(_GZIP, at):
                content, after = inflate(raw, at, most)
                inside = list(_plain(content, 0, len(content), False, most))
                if content and not any(isinstance(x, Record) for x in inside):
                    raise Damaged("no record in the member")
                found: list[Record | Gap] = []
                for x in inside:
                    # What stands in a member is placed by the member.
                    found.append(
                        Record(x.headers, x.block, at, after)
                        if isinstance(x, Record)
                        else Gap(at, after, f"in the member: {x.reason}")
                    )
            else:
                one = parse(raw, at)
                found, after = [one], one.end
        except Damaged as error:
            if gap is None:
                gap, reason = at, str(error)
            following = _START.search(raw, at + 1)
            at = following.start() if following else end
            continue
        if gap is not None:
            yield Gap(gap, at, reason)
            gap = None
        yield from found
        at = after
    if gap is not None:
        yield Gap(gap, end, reason)


def salvage(raw: bytes, most: int = 1 << 30) -> Iterator[Record | Gap]:
    """All records that can be read from an archive, and the gaps between them, in order."""
    yield from _plain(raw, 0, len(raw), True, most)


_WRITTEN = "archive binary"
_READ = (
    "archive string, offset long, end long, record_id string, type string, uri string, "
    "refers_to string, payload binary, payload_digest string, payload_bytes long, gap string"
)


def _archives(level: int, arrow: pa.Schema):
    """Rows id, uri, raw, response, digest become archives of limited size."""

    def one(number, uri, raw, response, digest) -> bytes:
        raw = raw or b""
        kind = "response" if response is None or response == number else "revisit"
        headers = {
            "WARC-Type": kind,
            "WARC-Record-ID": f"<urn:row:{'' if number is None else number}>",
            "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
            "Payload-Length": str(len(raw)),
        }
        if uri is not None:
            headers["WARC-Target-URI"] = re.sub(r"[\r\n]+", " ", uri)
        if kind == "revisit":
            headers |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": f"<urn:row:{response}>"}
            raw = b""
        return member(record(headers, raw), level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(one(*row))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)])], schema=arrow)
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)])], schema=arrow)

    return run


def write_archives(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = 1000,
    level: int = 6,
) -> None:
    """Writes a record for each row into archives below the path."""
    raw = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("id"),
        F.col(f"`{url}`").cast("string").alias("uri"),
        raw.alias("raw"),
    )
    rows = rows.withColumn("digest", F.sha1("raw"))
    copies = (
        rows.where(F.length("raw") >= least)
        .groupBy("digest")
        .agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("digest", "response")
    )
    # Written first: Spark then knows its size, and sends it to the tasks if it is small.
    copies = materialise(copies, "copies")
    rows = rows.join(copies, "digest", "left").select("id", "uri", "raw", "response", "digest")
    arrow = to_arrow_schema(StructType.fromDDL(_WRITTEN))
    archives = rows.mapInArrow(_archives(level, arrow), _WRITTEN)
    # The text writer puts bytes down as they are; each archive is a file and ends in a line end.
    archives.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives below the path, one row each.

    A gap has a reason in `gap` and no other column but archive, offset and end. payload_digest
    and payload_bytes are those of the full payload, which a revisit does not carry.
    """
    arrow = to_arrow_schema(StructType.fromDDL(_READ))

    def row(name: str, found: Record | Gap) -> tuple:
        if isinstance(found, Gap):
            return (name, found.offset, found.end, *[None] * 7, found.reason)
        h = found.headers
        digest = h.get("warc-payload-digest", "")
        known = digest[5:] if digest.lower().startswith("sha1:") else None
        own = found.block if h.get("warc-type") != "revisit" else None
        hexed = base64.b32decode(known).hex() if known else hashlib.sha1(found.block).hexdigest()
        length = h.get("payload-length", "")
        size = int(length) if own is None and length.isdigit() else len(found.block)
        return (
            name,
            found.offset,
            found.end,
            h.get("warc-record-id"),
            h.get("warc-type"),
            h.get("warc-target-uri"),
            h.get("warc-refers-to"),
            own,
            hexed,
            size,
            None,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows: list[tuple] = []
                for found in salvage(raw):
                    rows.append(row(name, found))
                    if len(rows) >= 1024:
                        yield _rows(rows, arrow)
                        rows = []
                if rows:
                    yield _rows(rows, arrow)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, _READ)


def _rows(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
    )
