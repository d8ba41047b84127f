from __future__ import annotations

import gzip
import hashlib
import random

import pytest
from edge_rows import CLASHING

from riskweave.llm import warc
from riskweave.session import scratch_path

SMALL = "/root/testdata/sf0.001"


def plain(rows):
    """Brute force: (page_id, bytes, digest, type, refers_to) of (page_id, html)."""
    first, out = {}, []
    for page, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        if len(data) >= 100 and digest in first:
            out.append((page, len(data), digest, "revisit", first[digest]))
        else:
            first.setdefault(digest, page)
            out.append((page, len(data), digest, "response", None))
    return sorted(map(str, out))


def test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = sorted(str(tuple(r)) for r in warc.archive_round_trip(pages).collect())
    assert got == plain([(r.page_id, r.html) for r in pages.collect()])


def edge_pages(spark):
    long = "".join(random.Random(1).choice("aé😀\r\n<>") for _ in range(150_000))
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 4
    rows = [
        (5, "http://a/ b\r\nX: y", long), (3, None, long), (9, "u", long), (1, "u", None), (2, "u", ""),
        (4, "u", "short"), (6, "u", "short"), (7, "u", tricky), (8, "é", tricky), (None, "u", "x" * 200),
        (10, "u", "y" * 100), (10, "u", "y" * 100), (11, "u", "z" * 99), (12, "u", "z" * 99),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(CLASHING)], "1 as size", "2 as digest"), rows


def test_edge_rows(spark):
    pages, rows = edge_pages(spark)
    got = sorted(str(tuple(r)) for r in warc.archive_round_trip(pages).collect())
    assert got == plain([(r[0], r[2]) for r in rows])
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_payloads_come_back_from_small_segments(spark):
    pages, rows = edge_pages(spark)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, segment_chars=1000, file_records=7)
    records = warc.read_records(spark, path)
    assert records.where("record_type = 'continuation'").count() > 100
    read = warc.read_payloads(spark, path, with_payload=True).collect()
    want = sorted((str(r[0] or ""), (r[2] or "").encode()) for r in rows)
    assert sorted((r.page, bytes(r.payload)) for r in read) == want


def test_broken_segments_give_no_payload(spark):
    pages, _ = edge_pages(spark)
    path = scratch_path(spark, "warc-broken")
    warc.write_archives(pages.where("page_id in (5, 7)"), path, segment_chars=1000)
    records = warc.read_records(spark, path)
    whole = warc.reassembled(records).where("block is not null").count()
    assert whole == 1
    for gone in ("not segment <=> 3", "total is null", "not segment <=> 1"):
        assert warc.reassembled(records.where(gone)).where("block is not null").count() == 0


def test_records_are_parsed_by_their_length():
    block = "WARC/1.0\r\n\r\n\r\n\r\n"
    data = (warc.record("a", [("X", "1")], block) + warc.record("b", [], "")).encode()
    found = list(warc.parse_records(data))
    assert [(h["warc-type"], b) for h, b in found] == [("a", block.encode()), ("b", b"")]
    assert list(warc.parse_records(b"")) == []
    for broken in (data[:-30], b"junk" + data):
        with pytest.raises(ValueError):
            list(warc.parse_records(broken))


@pytest.mark.parametrize("text", ["", "a", "é😀" * 3000, "0\r\n\r\n" * 10])
def test_chunked_framing(text):
    assert warc.dechunked(warc.chunked(text, 7).encode()) == text.encode()
    for cut in (1, 3):
        with pytest.raises(ValueError):
            warc.dechunked(warc.chunked(text + "abc", 7).encode()[: -7 - cut])


def test_archives_are_gzip_files(spark):
    pages, _ = edge_pages(spark)
    path = scratch_path(spark, "warc-gzip")
    warc.write_archives(pages, path)
    files = spark.read.format("binaryFile").load(path).collect()
    assert all(gzip.decompress(f.content).startswith(b"WARC/1.1\r\n") for f in files if gzip.decompress(f.content))
