"""WARC records in ZIP-packaged archives: a writer, and a reader by ranges.

An archive is a ZIP file with stored (uncompressed) members ``archive/data.warc``
and ``indexes/index.cdxj``.  The reader finds the end of the central directory,
follows the ZIP64 records where sizes, offsets or counts need them, locates the
members, reads the index and then only the byte ranges of records; nothing is
unpacked.  Archives lie in any store that ``pyarrow.fs`` opens by URI.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_words, lean, maybe_among, new_path, store_of, tune, written

DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"
RANGE_BYTES = 4 << 20  # records read at once
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- writing


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value without line breaks or blanks."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record with the payload, or a revisit record that names the record that has it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Streams records into one archive; the index is held until the end."""

    def __init__(self, uri: str):
        store, path = store_of(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> None:
        data = record(page_id, url, payload, refers_to, date)
        self.member.write(data)
        self.index.append(json.dumps({"id": page_id, "offset": self.at, "length": len(data)}))
        self.at += len(data)

    def close(self) -> None:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
            for line in self.index:
                member.write(line.encode() + b"\n")
        self.zip.close()
        self.out.close()


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages(page_id, url, html)``, returns the manifest ``(path, records)``.

    Of rows with equal payloads (null html is the empty one) those with the
    largest page_id are responses, the others revisits.  Digests alone are
    grouped, summed before they are exchanged, so a large group of copies is one
    row; pages that may have an equal then meet their decision by page_id.  Each attempt of a task
    writes a file of its own and only the files of tasks that succeeded reach
    the manifest.  A row with a null page_id cannot be referred to; it is a
    response or a revisit like any other.  No rows give no archives.
    """
    spark = pages.sparkSession
    tune(spark)
    folder = folder or new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digests = rows.select("page_id", F.unhex(F.sha1("html")).alias("digest"))
    groups = digests.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    links = digests.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    links = links.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first").distinct()
    # Only rows that may have an equal are exchanged; the others are written where they are read.
    hashed = maybe_among(rows, key_words(groups, F.xxhash64("digest")), F.xxhash64(F.unhex(F.sha1("html"))))
    on = F.col("page_id").eqNullSafe(F.col("_id")) & (F.unhex(F.sha1("html")) == F.col("_digest"))
    columns = ["page_id", "url", "html", "first"]
    alone = hashed.where("not __mesh_maybe").withColumn("first", F.lit(None).cast("long")).select(*columns)
    marked = alone.union(hashed.where("__mesh_maybe").join(links, on, "left").select(*columns))
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, path, n = None, f"{folder}/{uuid.uuid4().hex}.wacz", 0
        for batch in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or ArchiveWriter(path)
                archive.add(page_id, url, html.encode(), first, date)
                n += 1
        if archive:
            archive.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return written(marked.mapInArrow(lean(write), "path string, records long"), "manifest")


# ---------------------------------------------------------------- reading


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int  # offset of the local header


def read_at(source, offset: int, length: int) -> bytes:
    source.seek(offset)
    return source.read(length)


def directory(source, size: int) -> list[Member]:
    """The central directory of a ZIP file, from the file's end."""
    tail = min(size, 65_557)
    end = read_at(source, size - tail, tail)
    at = end.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(end) or at + 22 + struct.unpack_from("<H", end, at + 20)[0] != len(end)):
        at = end.rfind(b"PK\x05\x06", 0, at)  # such bytes inside a comment
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", end, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read_at(source, size - tail + at - 20, 20) if size - tail + at >= 20 else b""
        if locator[:4] == b"PK\x06\x07":
            record64 = read_at(source, struct.unpack_from("<Q", locator, 8)[0], 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("broken ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", record64, 32)
    data, members, at = read_at(source, start, length), [], 0
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", data, at + 10)[0]
        stored, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode()
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        e = 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # 64-bit values, in this order, of the fields that are full
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                stored = next(values) if stored == 0xFFFFFFFF else stored
                header = next(values) if header == 0xFFFFFFFF else header
            e += 4 + n
        members.append(Member(name, method, stored, header))
        at += 46 + n_name + n_extra + n_comment
    return members


def member_start(source, member: Member) -> int:
    """Offset of a stored member's first byte."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    local = read_at(source, member.header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def ranges(uri: str, most: int = RANGE_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges (offset, length) of an archive that hold whole records, by its index."""
    store, path = store_of(uri)
    with store.open_input_file(path) as source:
        members = {m.name: m for m in directory(source, source.size())}
        base = member_start(source, members[DATA])
        index, first = members[INDEX], member_start(source, members[INDEX])
        begin = length = at = 0
        rest = b""
        while at < index.size:
            piece = read_at(source, first + at, min(1 << 20, index.size - at))
            at += len(piece)
            lines = (rest + piece).split(b"\n")
            rest = lines.pop()
            for line in lines:
                entry = json.loads(line)
                if length and (length + entry["length"] > most or entry["offset"] != begin + length):
                    yield base + begin, length
                    length = 0
                if not length:
                    begin = entry["offset"]
                length += entry["length"]
        if length:
            yield base + begin, length


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each WARC record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = end + 4
        stop = begin + int(headers["content-length"])
        yield headers, data[begin:stop]
        at = stop + 4


def _urn(value: str | None) -> int | None:
    return int(value[len("<urn:page:") : -1]) if value and value != "<urn:page:>" else None


def parsed(headers: dict[str, str], block: bytes) -> dict:
    """One result row; the digest of a response is computed from its payload and must agree."""
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].partition(":")[2]
    length = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
    kind = headers["warc-type"]
    if kind == "response":
        found = base32_sha1(payload)
        if found != digest or len(payload) != length:
            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
    return {
        "page_id": _urn(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload_bytes": length,
        "payload_digest": digest, "record_type": kind, "refers_to": _urn(headers.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


_FIELDS = [
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
]


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of all records of ``manifest(path)``.

    With ``payloads`` also url and payload (null for a revisit).  Archives are
    planned from their indexes and the ranges, not the files, are dealt to tasks.
    """
    tune(manifest.sparkSession)
    schema = pa.schema(_FIELDS + ([("url", pa.string()), ("payload", pa.binary())] if payloads else []))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = list(ranges(path))
                yield pa.RecordBatch.from_pydict(
                    {"path": [path] * len(found), "offset": pa.array([a for a, _ in found], pa.int64()), "length": pa.array([n for _, n in found], pa.int64())}
                )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = store_of(row["path"])
                with store.open_input_file(path) as source:
                    data = read_at(source, row["offset"], row["length"])
                rows = [parsed(h, b) for h, b in records(data)]
                yield pa.RecordBatch.from_pylist([{k: x[k] for k in schema.names} for x in rows], schema=schema)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    planned = manifest.select("path").repartition(n, "path").mapInArrow(lean(plan), "path string, offset long, length long")
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return planned.repartition(n, "path", "offset").mapInArrow(lean(read), ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives and returns what the reader finds in them.

    Null html is an empty payload; of equal payloads the largest page_id is the
    response.  Other columns are ignored; an empty table gives an empty result.
    """
    return read_archives(write_archives(pages))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, sha1(html) AS hex FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(concat('0x', substr(hex, i // 8 * 10 + 1, 10)) AS BIGINT) >> (35 - i % 8 * 5)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h
"""
