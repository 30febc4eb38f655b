"""op10 over whole pages against a brute-force version, and pages that are hard to archive."""

import base64
import hashlib
import os

import pytest

from conftest import SF
from tallyrill.llm import queries, warc_zip

SCHEMA = "page_id long, url string, html string, size long, payload string, first string, rows int"


def brute(rows, min_bytes=0):
    """(page, bytes, digest, type, refers_to) of every row, one by one in the order of ids (nulls last)."""
    seen, out = {}, []
    for page, _, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        if len(data) >= min_bytes and data in seen:
            out.append((page, len(data), digest, "revisit", seen[data]))
        else:
            seen[data] = page
            out.append((page, len(data), digest, "response", None))
    return sorted(out, key=repr)


def archived(spark, df, **options):
    path = queries.shared_folder(spark, "test-archives")
    warc_zip.write_archives(df, path, **options)
    return path, spark.read.parquet(path)


@pytest.mark.parametrize("folder", [SF, SF.replace("0.001", "0.01")])
def test_all_pages(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted([tuple(r) for r in queries.op10_warc_zip(spark, folder).collect()], key=repr) == brute(rows)


@pytest.mark.parametrize("min_bytes", [0, 1, 5, 10**9])
def test_hard_pages(spark, min_bytes):
    long = "<p>å " * 3_000_000
    rows = [
        (1, "http://a/\r\n\r\nX-Page: 9", "<p>x"), (2, "http://a/ b\tc\x00\x7f", "<p>x"), (3, "ü" * 5000, ""), (4, None, None), (5, "", long),
        (6, "u", long), (None, "\r\n", "<p>y"), (None, "\r\n", "<p>y"), (7, "u", "WARC/1.1\r\n\r\n"), (7, "v", "WARC/1.1\r\n\r\n"), (-8, "x", "\r\n\r\n"),
    ]
    df = spark.createDataFrame([(*r, 1, "p", "f", 3) for r in rows], SCHEMA).repartition(3)
    _, archives = archived(spark, df, min_bytes=min_bytes)
    got = warc_zip.read_archives(archives, keep_payload=True).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == brute(rows, min_bytes)
    texts = {(d, n): html for d, n, html in ((base64.b32encode(hashlib.sha1((r[2] or "").encode()).digest()).decode(), len((r[2] or "").encode()), r[2] or "") for r in rows)}
    assert all(r.payload.decode() == texts[r.payload_digest, r.payload_bytes] for r in got if r.record_type == "response")


def test_headers_of_urls():
    for uri in ("http://a/\r\n\r\nContent-Length: 9", "a b", "\x00\x1f\x7f", "å/ü?q=%20&x=[1]", "\ud800"):
        record = warc_zip.warc_record("response", "1", uri, "D", 1, b"x", None)
        headers, payload = warc_zip.parse_record(record)
        assert payload == b"x" and headers["warc-target-uri"] == warc_zip.header_uri(uri) and headers["x-page"] == "1"
    assert warc_zip.header_uri("http://h/p?a=%20&b=[1]#x") == "http://h/p?a=%20&b=[1]#x"


def test_ranges_of_a_file(spark, tmp_path):
    df = spark.createDataFrame([(k, f"u{k}", "x" * k) for k in range(50)], "page_id long, url string, html string").coalesce(1)
    _, archives = archived(spark, df)
    content = bytes(archives.first().content)
    (tmp_path / "a.zip").write_bytes(content)
    read, size = warc_zip.file_reader(os.fspath(tmp_path / "a.zip"))
    spans = []

    def watched(at, n):
        spans.append(n)
        return read(at, n)

    records = list(warc_zip.archive_records(watched, size))
    assert [p for _, p in records] == [p for _, p in warc_zip.archive_records(lambda at, n: content[at : at + n], len(content))] and len(records) == 50
    assert max(spans[-50:]) < 1000  # each record by its own range
