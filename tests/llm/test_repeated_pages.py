"""Pages that repeat an id and payload under other urls: a record for each row."""

from collections import Counter

from tallyrill.llm import queries, warc_zip


def test_every_row_keeps_its_url(spark):
    rows = [(1, "u", "<p>a"), (1, "v", "<p>a"), (1, "v", "<p>a"), (1, None, "<p>a"), (2, "w", "<p>a"), (None, "x", "<p>b"), (None, "y", "<p>b"), (3, "z", "<p>c")]
    path = queries.shared_folder(spark, "test-archives")
    warc_zip.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    records = []
    for r in spark.read.parquet(path).collect():
        content = bytes(r.content)
        records += [headers for headers, _ in warc_zip.archive_records(lambda at, n: content[at : at + n], len(content))]  # noqa: B023
    label = lambda page: "-" if page is None else str(page)
    digests = {html: "sha1:" + warc_zip.base32_sha1(html.encode()) for _, _, html in rows}
    assert Counter((h["x-page"], h["warc-target-uri"], h["warc-payload-digest"]) for h in records) == Counter((label(p), u or "urn:unknown", digests[html]) for p, u, html in rows)
    whole = Counter(h["warc-payload-digest"] for h in records if h["warc-type"] == "response")
    assert whole == Counter(digests.values())
