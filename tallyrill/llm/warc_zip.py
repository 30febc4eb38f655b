"""Operator 10: WARC records in ZIP-packaged archives, read without extraction.

An archive is a ZIP file with a stored member ``archive/data.warc`` and a stored
index ``indexes/index.cdx``.  The reader needs nothing but range reads: it finds
the end record (and the ZIP64 one), walks the central directory, locates the
stored members, and reads single records by the index's offsets.

``write_archives`` packs each partition's pages into archives of bounded size and
writes them as rows (archive, content) of a Parquet table in the shared folder, so
that any executor, and any later job, can read them from any file system that
Spark reads.  ``read_archives`` range-reads every indexed record of every archive;
the ranges are taken from an archive that Spark has loaded as one value, at most
ARCHIVE_BYTES and one record long.  ``file_reader`` gives the same reader ranges of
a file that lies on a mounted file system, without loading the rest.

Of pages with equal payloads (at least ``min_bytes`` long) the one with the
smallest id is a response record with the payload, others are revisit records.
Equal payloads are found by SHA-256 with map-side minima.  Only slim rows are joined
with them; payloads themselves are shuffled once, copies combined before that, as
records that revisit another need none.

Defined results: null html counts as empty; null ids come last, so they are
responses only where a group has no other; of repeated rows (one id, one payload)
one is the response and the others revisit it; null urls count as unknown, and
characters that would break a header are percent-encoded; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

DATA, INDEX = "archive/data.warc", "indexes/index.cdx"
#: Payload bytes after which a new archive begins.
ARCHIVE_BYTES = 8 << 20
#: Fixed value: the date that records carry, so that reruns agree.
DATE = "2020-01-01T00:00:00Z"
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF
_PLAIN = "".join(map(chr, range(33, 127)))


def warc_record(kind: str, page: str, uri: str, digest: str, size: int, payload: bytes, refers_to: str | None, copy: int = 0) -> bytes:
    """One WARC/1.1 record; the page id and the full payload's size travel in extension headers."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}:{digest}:{kind}:{copy}:{header_uri(uri)}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {header_uri(uri)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page: {page}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def header_uri(uri: str) -> str:
    """``uri`` for a header line: control characters, spaces and all beyond ASCII percent-encoded; what is encoded already stays."""
    return quote(uri, safe=_PLAIN, errors="replace")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:size].partition(b"\r\n\r\n")[2]


def zip_stored(members: list[tuple[str, bytes]], force64: bool = False) -> bytes:
    """A ZIP file of stored members, with ZIP64 records where sizes need them or ``force64``."""
    out, entries = [], []
    at = 0
    for name, data in members:
        label, crc, size = name.encode(), zlib.crc32(data), len(data)
        wide = force64 or size >= _MAX32 or at >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        short = _MAX32 if wide else size
        version = 45 if wide else 20
        local = struct.pack("<4sHHHHHIIIHH", _LOCAL, version, 0x800, 0, 0, 0x21, crc, short, short, len(label), len(extra)) + label + extra
        central = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        entries.append(struct.pack("<4sHHHHHHIIIHHHHHII", _ENTRY, version, version, 0x800, 0, 0, 0x21, crc, short, short, len(label), len(central), 0, 0, 0, 0, _MAX32 if wide else at) + label + central)
        out += [local, data]
        at += len(local) + size
    directory = b"".join(entries)
    n, size = len(entries), len(directory)
    tail = b""
    if force64 or at >= _MAX32 or n >= _MAX16:
        tail = struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, at) + struct.pack("<4sIQI", _LOCATOR, 0, at + size, 1)
        end = struct.pack("<4sHHHHIIH", _END, 0, 0, _MAX16, _MAX16, _MAX32, _MAX32, 0)
    else:
        end = struct.pack("<4sHHHHIIH", _END, 0, 0, n, n, size, at, 0)
    return b"".join([*out, directory, tail, end])


Reader = Callable[[int, int], bytes]


def file_reader(path: str) -> tuple[Reader, int]:
    """(range reader, size) of a file, for ``archive_records``; each range is one positioned read."""
    handle = os.open(path, os.O_RDONLY)

    def read(at: int, n: int) -> bytes:
        return os.pread(handle, n, at)

    return read, os.fstat(handle).st_size


def zip_members(read: Reader, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Name to (first data byte, size, method, crc) of every member, from range reads alone."""
    span = min(size, 22 + _MAX16)
    tail = read(size - span, span)
    k = tail.rfind(_END)
    if k < 0:
        raise ValueError("no ZIP end record")
    n, length, at = struct.unpack_from("<HII", tail, k + 10)
    if _MAX32 in (length, at) or n == _MAX16:
        place = size - span + k - 20
        locator = read(place, 20) if place >= 0 else b""
        if locator[:4] != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        (where,) = struct.unpack_from("<Q", locator, 8)
        record = read(where, 56)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end record")
        n, length, at = struct.unpack_from("<QQQ", record, 32)
    directory, p, found = read(at, length), 0, {}
    for _ in range(n):
        if directory[p : p + 4] != _ENTRY:
            raise ValueError("the central directory is damaged")
        method, _, _, crc, packed, full, a, b, c, _, _, _, offset = struct.unpack_from("<HHHIIIHHHHHII", directory, p + 10)
        name = directory[p + 46 : p + 46 + a].decode()
        q, stop = p + 46 + a, p + 46 + a + b
        while q + 4 <= stop:
            tag, width = struct.unpack_from("<HH", directory, q)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{width // 8}Q", directory, q + 4))
                if full == _MAX32:
                    full = wide.pop(0)
                if packed == _MAX32:
                    packed = wide.pop(0)
                if offset == _MAX32:
                    offset = wide.pop(0)
            q += 4 + width
        local = read(offset, 30)
        if local[:4] != _LOCAL:
            raise ValueError("a local header is damaged")
        a2, b2 = struct.unpack_from("<HH", local, 26)
        found[name] = (offset + 30 + a2 + b2, full, method, crc)
        p = stop + c
    return found


def archive_records(read: Reader, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every indexed record of an archive, each by one range read of the stored member."""
    members = zip_members(read, size)
    at, length, method, _ = members[INDEX]
    start, stop, stored, _ = members[DATA]
    if method or stored:
        raise ValueError("members must be stored")
    for line in read(at, length).decode().splitlines():
        _, offset, n = line.rsplit(" ", 2)
        if int(offset) + int(n) > stop:
            raise ValueError("the index points beyond its member")
        yield parse_record(read(start + int(offset), int(n)))


def build_archive(records: list[tuple[str, bytes]], force64: bool = False) -> bytes:
    """An archive of (page, record) pairs with its index."""
    lines, at = [], 0
    for page, record in records:
        lines.append(f"{page} {at} {len(record)}")
        at += len(record)
    return zip_stored([(DATA, b"".join(r for _, r in records)), (INDEX, "\n".join(lines).encode())], force64)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(page, url, digest, size, rows, shared, first, html): distinct (page, url, payload) rows, how often each occurs, and the page that holds the payload.

    ``html`` is null where all of a row's records are revisits.  Payloads move in one
    exchange, each distinct one once from every scan task; all else is slim rows.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    raw = html.cast("binary")
    short = F.when(F.octet_length(raw) < min_bytes, html)  # under min_bytes: travels with its row
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.sha2(raw, 256).alias("payload"), F.sha1(raw).alias("digest"), F.octet_length(raw).cast("long").alias("size"), short.alias("short"))
    rows = checkpoint(rows.groupBy("page", "url", "payload", "digest", "size", "short").agg(F.count(F.lit(1)).alias("rows")), "page-rows")
    # null ids last: (is null, id) is least for the smallest id; urls settle repeats of an id
    rank = F.struct(F.col("page").isNull().alias("none"), "page", F.col("url").isNull().alias("unknown"), "url")
    first = rows.where(F.col("size") >= min_bytes).groupBy("payload").agg(F.min(rank).alias("first"))
    planned = rows.join(first, "payload", "left").select(*rows.columns, "first", F.col("first").eqNullSafe(rank).alias("holds"))
    held = pages.select(F.sha2(raw, 256).alias("payload"), html.alias("html")).where(F.octet_length("html") >= min_bytes).groupBy("payload").agg(F.first("html").alias("html"))
    shape = ["page", "url", "digest", "size", "rows", F.col("first").isNotNull().alias("shared"), F.col("first.page").alias("first")]
    leads = planned.where("holds").join(held, "payload").select(*shape, "html")
    others = planned.where("not holds").select(*shape, F.col("short").alias("html"))
    return leads.unionByName(others)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> None:
    """Archives of all rows of ``pages`` as a Parquet table (archive, content) at ``path``."""

    def packed(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
        content = build_archive(held)
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(content).hexdigest()]), pa.array([content], pa.binary())], ["archive", "content"])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page", "url", "digest", "size", "rows", "shared", "first", "html")]
            for page, url, digest, length, rows, shared, first, html in zip(*columns):
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                label, payload = "-" if page is None else str(page), None if html is None else html.encode()
                for copy in range(rows):
                    response = not shared or (payload is not None and copy == 0)
                    record = warc_record("response" if response else "revisit", label, url or "urn:unknown", digest, length, payload if response else b"", "-" if first is None else str(first), copy)
                    held.append((label, record))
                    size += len(record)
                    if size >= ARCHIVE_BYTES:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    planned = plan_records(pages, id_col, url_col, html_col, min_bytes)
    planned.mapInArrow(pack, "archive string, content binary").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)


def read_archives(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """One row per record of the archives (content): page_id, payload_bytes, payload_digest, record_type, refers_to [, payload].

    A response's payload must have the digest and the size that its headers state.
    """

    def run(batches):
        number = lambda x: None if x in (None, "-") else int(x)
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_buffer()
                read = lambda at, n: data.slice(at, n).to_pybytes()
                out: list[list] = [[], [], [], [], [], []]
                for headers, payload in archive_records(read, data.size):
                    digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
                    kind = headers["warc-type"]
                    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError("a payload differs from its digest")
                    for column, value in zip(out, (number(headers["x-page"]), size, digest, kind, number(headers.get("x-refers-to-page")), payload if keep_payload else None)):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    out = archives.select("content").mapInArrow(run, schema)
    return out if keep_payload else out.drop("payload")
