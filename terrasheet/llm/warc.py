"""WARC archives: written by Spark, read back by a reader that salvages what it can.

Writing. A page whose payload (at least LEAST_REVISIT bytes) equals that of a page with a larger id becomes a revisit
record, which has no payload but names the response. Payloads are compared by their SHA-256; only digests and ids are
grouped and joined, and only revisits are joined with the pages, by id and digest, so that no key is hot. Whole records,
ROW_BYTES of them or so, are one row of Spark's text writer, whose commit protocol takes care of lost executors, and
FILE_ROWS rows are a file: that bounds files by bytes. A plain record ends with the writer's line separator, CRLF. A
compressed record is a gzip member (or several, of at most MEMBER_BYTES each), whose last byte, the highest of its length,
is always zero and is the separator.

Reading. A file is walked from record to record. Each must have a version line, headers, a block of the length that they
tell, two line ends, and the digests that they tell; a gzip member must end with its checksum. Where a check fails, the
reader looks for the next member or version line at which a whole record begins, reads on from there, and reports the
bytes between as a gap with the reason. gaps are the log of what was quarantined; complete makes any of them an error.

Null payloads are empty, null addresses `urn:none`; a null id is smaller than all others. Rows that share id and payload
get records of one id. Other columns don't matter. An archive that is read must fit in a task's memory, as must a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, text_slices

LEAST_REVISIT = 1000
#: Bytes of records (before compression) that make a row of the text writer, or one longer record, and rows of a file.
ROW_BYTES, FILE_ROWS = 4 << 20, 16
#: Bytes of a gzip member before compression: under 1 << 24, so that the last byte of its length is zero.
MEMBER_BYTES = 15 << 20

ID_PREFIX = "urn:x-page:"
END = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


class Record(NamedTuple):
    begin: int
    end: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    begin: int
    end: int
    reason: str


class Broken(Exception):
    """A record that fails a check; its text is the reason."""


# ---- records


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(value: str | None) -> str | None:
    return base64.b32decode(value[5:]).hex() if value and value.startswith("sha1:") else None


def record(number: str, url: str, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit of the page refers_to, as the bytes of a record without the last CRLF."""
    head = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{ID_PREFIX}{number}>"), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)), ("WARC-Date", date)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>")]
    else:
        block += payload
    head += [("WARC-Payload-Digest", digest(payload)), ("X-Payload-Length", len(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n"


def members(data: bytes, level: int = 6) -> list[bytes]:
    """gzip members of a whole record, each without its last byte, a zero."""
    out = []
    for k in range(0, len(data), MEMBER_BYTES):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        out.append((packer.compress(data[k : k + MEMBER_BYTES]) + packer.flush())[:-1])
    return out


def packed_record(data: bytes, level: int = 6) -> bytes:
    """All members of a whole record as one row, so that no file ends inside a record; without the last zero."""
    return b"\0".join(members(data, level))


# ---- writing


def with_revisits(pages: DataFrame, id_column: str, url_column: str, payload_column: str, least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, payload, refers_to): refers_to is the largest id with an equal payload, or null for a response."""
    payload = F.encode(F.coalesce(F.col(payload_column), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_column).alias("id"), F.coalesce(F.col(url_column).cast("string"), F.lit("urn:none")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    known = rows.where("same is not null").select("id", "same")
    last = stored(known.groupBy("same").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select("same", "last"), "warc-groups")
    revisits = stored(known.join(last, "same").where(~F.col("id").eqNullSafe(F.col("last"))).distinct().toDF("_same", "_id", "refers_to"), "warc-revisits")
    both = rows.join(revisits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("same") == F.col("_same")), "left")
    return both.select("id", "url", "payload", "refers_to")


def write_archives(rows: DataFrame, path: str, compress: bool = True, date: str = "2026-01-01T00:00:00Z", row_bytes: int = ROW_BYTES, file_rows: int = FILE_ROWS) -> None:
    """Writes rows (id, url, payload, refers_to) as archives in the folder `path`, with Spark's text writer."""
    end = b"\0" if compress else b"\r\n"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in text_slices(batches, "payload"):
            for number, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to")), strict=True):
                own = record(str(number), url, date, payload, refers_to)
                if held and size + len(own) > row_bytes:
                    yield row(held)
                    held, size = [], 0
                held.append(packed_record(own + b"\r\n") if compress else own)
                size += len(own)
        if held:
            yield row(held)

    def row(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], ["record"])

    given = rows.select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))
    lines = given.mapInArrow(build, "record binary").select(F.col("record").cast("string"))
    lines.write.option("lineSep", end.decode()).option("maxRecordsPerFile", file_rows).text(path)


# ---- reading


def checked(data: bytes, at: int, whole: bool) -> tuple[Record, int]:
    """The record at `at`, and its end. whole: data ends with the record."""
    if not _VERSION.match(data, at):
        raise Broken("no version line")
    head_end = data.find(END, at)
    if head_end < 0:
        raise Broken("headers without an end")
    headers = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("a header without a colon")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Broken("no length")
    begin = head_end + len(END)
    end = begin + int(size)
    if data[end : end + 4] != END or whole and len(data) != end + 4:
        raise Broken("the block doesn't end where its length tells")
    block = data[begin:end]
    if headers.get("warc-block-digest", "").startswith("sha1:") and headers["warc-block-digest"] != digest(block):
        raise Broken("block digest")
    if headers.get("warc-type") == "response" and headers.get("warc-payload-digest", "").startswith("sha1:") and headers["warc-payload-digest"] != digest(payload_of(headers, block)):
        raise Broken("payload digest")
    return Record(at, end + 4, headers, block), end + 4


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """A block without the HTTP header that it begins with, if it is HTTP."""
    return block.partition(END)[2] if headers.get("content-type", "").startswith("application/http") else block


def member(data: memoryview, at: int) -> tuple[bytes, int]:
    """What a gzip member holds, and its end."""
    unpack, out, step = zlib.decompressobj(31), [], 512
    try:
        while not unpack.eof:
            if at >= len(data):
                raise Broken("a member without an end")
            part = data[at : at + step]
            out.append(unpack.decompress(part))
            at += len(part)
            step = 1 << 16
        return b"".join(out), at - len(unpack.unused_data)
    except zlib.error as e:
        raise Broken(f"gzip: {e}") from None


def compressed(data: memoryview, at: int) -> tuple[Record, int]:
    """The record of the member at `at`, and of those that follow it if it is longer."""
    held, end = member(data, at)
    if not _VERSION.match(held):
        raise Broken("a member without a version line")
    head_end = held.find(END)
    while head_end < 0 and bytes(data[end : end + 3]) == b"\x1f\x8b\x08":  # headers longer than a member
        more, end = member(data, end)
        searched, held = max(0, len(held) - len(END) + 1), held + more
        head_end = held.find(END, searched)
    length = re.search(rb"(?im)^content-length:\s*(\d+)", held[: max(head_end, 0)])
    need = head_end + 8 + int(length[1]) if length else 0
    if len(held) < need:
        parts, have = [held], len(held)
        while have < need and bytes(data[end : end + 3]) == b"\x1f\x8b\x08":
            more, end = member(data, end)
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
    found, _ = checked(held, 0, True)
    return found._replace(begin=at, end=end), end


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """The records of an archive in order, and the gaps between them."""
    view, at, lost, reason = memoryview(data), 0, None, ""
    while at < len(data):
        try:
            found, end = compressed(view, at) if data[at : at + 2] == b"\x1f\x8b" else checked(data, at, False)
        except Broken as e:
            if lost is None:
                lost, reason = at, str(e)
            following = _NEXT.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if lost is not None:
            yield Gap(lost, at, reason)
            lost = None
        yield found
        at = end
    if lost is not None:
        yield Gap(lost, len(data), reason)


READ = "archive string, begin long, end long, gap string, type string, record_id string, url string, refers_to string, payload_digest string, payload_length long, payload binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record and each gap of the archives in a folder (READ).

    gap: why the bytes from begin to end were left out, null for records; type, record_id, url, refers_to: the headers;
    payload_digest: SHA-1 in hexadecimal, as told (for responses it has been checked); payload_length: of the payload that
    the record tells or holds; payload: null for gaps and revisits.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for x in salvage(data.as_py()):
                    if isinstance(x, Gap):
                        rows.append((name, x.begin, x.end, x.reason, *[None] * 7))
                        continue
                    h = x.headers
                    revisit = h.get("warc-type") == "revisit"
                    payload = None if revisit else payload_of(h, x.block)
                    told = h.get("x-payload-length", "")
                    bare = [(h[k].strip("<>") if k in h else None) for k in ("warc-record-id", "warc-target-uri", "warc-refers-to")]
                    size = len(payload) if payload is not None else int(told) if told.isascii() and told.isdigit() else None
                    own = hex_digest(h.get("warc-payload-digest")) or (hashlib.sha1(payload).hexdigest() if payload is not None else None)
                    rows.append((name, x.begin, x.end, None, h.get("warc-type"), *bare, own, size, payload))
                    held += len(x.block)
                    if held > 8 << 20:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(read, READ)


def gaps(found: DataFrame) -> DataFrame:
    """The log of what was left out: (archive, begin, end, gap) of the rows of read_archives."""
    return found.where("gap is not null").select("archive", "begin", "end", "gap")


def complete(found: DataFrame) -> DataFrame:
    """The records of read_archives; a gap is an error that names its archive, bytes and reason."""
    told = F.concat(F.lit("a gap in "), F.col("archive"), F.lit(", bytes "), F.col("begin").cast("string"), F.lit(" to "), F.col("end").cast("string"), F.lit(": "), F.col("gap"))
    return found.where(F.when(F.col("gap").isNull(), True).otherwise(F.raise_error(told).isNull()))
