"""WARC archives written and read by Spark, with segmented records put together again.

Writing: a payload becomes an HTTP response with chunked transfer framing; a block over the
segment size is cut into a first record and continuation records, which may land in other files.
Equal payloads are stored once, later ones as revisit records. Archives are plain text files of
Spark's writer, gzipped, so they lie wherever Spark can write.

Reading: files are parsed record by record by their content lengths; continuation records are
grouped by the id of their first record, ordered by segment number, checked against the total
length, and the chunked framing is decoded.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import scratch_path, store

LEAST_BYTES = 100  # payloads below are never revisits
SEGMENT_CHARS = 16_384
CHUNK_CHARS = 4_096
FILE_RECORDS = 1_000
DATE = "2024-01-01T00:00:00Z"
_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(text: str, size: int = CHUNK_CHARS) -> str:
    """HTTP chunked transfer framing of the UTF-8 bytes of `text`, cut between characters."""
    parts = [text[i : i + size] for i in range(0, len(text), size)]
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body. Raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("HTTP header is missing")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body


def one_line(value: str) -> str:
    """Safe as a header value: characters that would end the line are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), value)


def record(kind: str, headers: list[tuple[str, str]], block: str) -> str:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block.encode())))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n" + block + "\r\n\r\n"


def response_records(number: str, page: str, url: str, html: str, digest: str, segment_chars: int) -> list[str]:
    """One record, or a first one and its continuations."""
    block = _HEAD + chunked(html)
    parts = [block[i : i + segment_chars] for i in range(0, len(block), segment_chars)]
    common = [
        ("WARC-Record-ID", f"<urn:uuid:{number}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Refers-To-Page", page),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if len(parts) == 1:
        return [record("response", common, block)]
    out = [record("response", [*common, ("WARC-Segment-Number", "1")], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        headers = [
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.UUID(number), str(i))}>"),
            ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", f"<urn:uuid:{number}>"),
            ("WARC-Segment-Number", str(i)),
        ]
        if i == len(parts):
            headers.append(("WARC-Segment-Total-Length", str(len(block.encode()))))
        out.append(record("continuation", headers, part))
    return out


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":  # between records
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, block
        at = end + 4 + size


def assign_records(
    pages: DataFrame, id_column: str, url_column: str, payload_column: str, least_bytes: int = LEAST_BYTES
) -> DataFrame:
    """(_row, page, url, html, size, digest, refers_to): which rows revisit which page.

    Of rows with equal payloads of at least `least_bytes` the one with the smallest id keeps the
    payload; among repeated rows of that id, the first. Only digests that several rows share
    are joined back.
    """
    html = F.coalesce(F.col(payload_column).cast("string"), F.lit(""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_column).alias("page"),
        F.coalesce(F.col(url_column).cast("string"), F.lit("")).alias("url"),
        html.alias("html"),
    ).withColumns(
        {"size": F.octet_length("html").cast("long"), "digest": F.sha2(F.col("html").cast("binary"), 256)}
    )
    order = F.struct(F.col("page").isNull().alias("unknown"), "page", "_row")
    shared = (
        rows.where(F.col("size") >= least_bytes)
        .groupBy("digest")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("_digest"), "first")
    )
    joined = rows.join(shared, (F.col("digest") == F.col("_digest")) & (F.col("size") >= least_bytes), "left")
    later = F.col("first").isNotNull() & (F.col("first._row") != F.col("_row"))
    return joined.select(
        "_row", "page", "url", F.when(~later, F.col("html")).alias("html"), "size", "digest",
        F.when(later, F.col("first._row")).alias("refers_row"),
        F.when(later, F.col("first.page")).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame,
    path: str,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    least_bytes: int = LEAST_BYTES,
    segment_chars: int = SEGMENT_CHARS,
    file_records: int = FILE_RECORDS,
) -> None:
    """Writes a record per row, long ones in segments, to gzipped archives below `path`.

    Each file has at most `file_records` records of a bounded size, so a reader's memory is
    bounded. A null payload is an empty one, and a null url an empty header.
    """
    space = uuid.uuid5(uuid.NAMESPACE_URL, path)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[str] = []
            for row, page, url, html, digest, first, target in zip(
                b["_row"], b["page"], b["url"], b["html"], b["digest"], b["refers_row"], b["refers_to"]
            ):
                number, page = str(uuid.uuid5(space, str(row))), "" if pd.isna(page) else str(page)
                if pd.isna(first):
                    out += response_records(number, page, one_line(url), html, digest, segment_chars)
                    continue
                headers = [
                    ("WARC-Record-ID", f"<urn:uuid:{number}>"),
                    ("WARC-Date", DATE),
                    ("WARC-Target-URI", one_line(url)),
                    ("WARC-Refers-To-Page", page),
                    ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(space, str(int(first)))}>"),
                    ("WARC-Payload-Digest", f"sha256:{digest}"),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ]
                out.append(record("revisit", headers, ""))
            # the text writer puts the last line end back
            yield pd.DataFrame({"value": [r[:-2] for r in out]})

    rows = assign_records(pages, id_column, url_column, payload_column, least_bytes)
    # page ids as text: they only label records
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page", "refers_to")})
    rows.mapInPandas(build, "value string").write.option("lineSep", "\r\n").option(
        "maxRecordsPerFile", file_records
    ).option("compression", "gzip").text(path)


_RECORD = (
    "record_id string, record_type string, page string, digest string, refers string, "
    "origin string, segment int, total long, block binary"
)
_NAMES = [c.split()[0] for c in _RECORD.split(", ")]
_MEASURED = "record_id string, payload_bytes long, payload_digest string"


def _record_row(headers: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(headers[name]) if name in headers else None
    return (
        headers.get("warc-record-id"),
        headers.get("warc-type"),
        headers.get("warc-refers-to-page"),
        headers.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        headers.get("warc-refers-to"),
        headers.get("warc-segment-origin-id"),
        number("warc-segment-number"),
        number("warc-segment-total-length"),
        block,
    )


def measured(block: bytes | None, stated: str | None) -> tuple[int | None, str | None, bytes | None]:
    """Size, digest and bytes of the payload in a block; nulls for what is not as stated."""
    try:
        payload = None if block is None else payload_of(block)
    except ValueError:
        payload = None
    digest = None if payload is None else hashlib.sha256(payload).hexdigest()
    if payload is None or digest != stated:
        return None, None, None
    return len(payload), digest, payload


def _archive_rows(content: bytes) -> list[tuple]:
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    return [_record_row(h, block) for h, block in parse_records(data)]


def _files(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(path).select("content")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives below `path`, continuations among them."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = _archive_rows(content)
                if rows:
                    yield pd.DataFrame(rows, columns=_NAMES).astype({"segment": "Int64", "total": "Int64"})

    return _files(spark, path).mapInPandas(parse, _RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """(record_id, block): segmented records whole again.

    A record whose segments are not 1 to n, or do not add up to the stated total length, gets a
    null block. Only the segments of one payload meet in one place.
    """
    parts = records.where("segment is not null").select(
        F.coalesce("origin", "record_id").alias("record_id"), "segment", "total", "block"
    )
    joined = parts.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    sizes = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    whole = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (sizes == F.col("total"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blocks = [b"".join(p) if ok else None for p, ok in zip(b["parts"], b["whole"])]
            yield pd.DataFrame({"record_id": b["record_id"], "block": blocks})

    return joined.select(
        "record_id",
        F.transform("parts", lambda p: p["block"]).alias("parts"),
        F.coalesce(whole, F.lit(False)).alias("whole"),
    ).mapInPandas(join, "record_id string, block binary")


def read_payloads(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(record_id, record_type, page, refers, payload_bytes, payload_digest[, payload]).

    Size and digest come from the payload that was read, for a revisit from that of the record
    it refers to. They are null where a record is broken or its payload is not what the header's
    digest says. Records of one segment are measured where they are parsed; blocks of others
    are kept until their segments meet.
    """
    more = ["payload"] * with_payload
    columns = _NAMES + ["payload_bytes", "payload_digest"] + more

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = []
                for row in _archive_rows(content):
                    single = row[1] == "response" and row[6] is None
                    found = measured(row[8], row[3]) if single else (None, None, None)
                    kept = row if row[6] is not None else row[:8] + (None,)
                    rows.append(kept + found[: 2 + with_payload])
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype(
                        {"segment": "Int64", "total": "Int64", "payload_bytes": "Int64"}
                    )

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *measured(x, d)[: 2 + with_payload]) for i, x, d in zip(b["record_id"], b["block"], b["digest"])]
            yield pd.DataFrame(rows, columns=["record_id", *columns[9:]]).astype({"payload_bytes": "Int64"})

    extra = ", payload binary" * with_payload
    schema = f"{_RECORD}, payload_bytes long, payload_digest string{extra}"
    records = store(_files(spark, path).mapInPandas(parse, schema), "records")
    heads = records.where("record_type <> 'continuation'")
    first = heads.where("record_type = 'response' and segment is not null").select("record_id", "digest")
    joined = reassembled(records).join(first, "record_id").mapInPandas(measure, _MEASURED + extra)
    single = heads.where("record_type = 'response' and segment is null").select("record_id", *columns[9:])
    payloads = single.unionByName(joined).withColumnRenamed("record_id", "_measured")
    target = F.when(F.col("record_type") == "revisit", F.col("refers")).otherwise(F.col("record_id"))
    return (
        heads.select("record_id", "record_type", "page", "refers", target.alias("_target"))
        .join(payloads, F.col("_target") == F.col("_measured"), "left")
        .drop("_target", "_measured")
    )


def archive_round_trip(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html"
) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to), as read back from archives.

    A row for each row of `pages`. Null payloads are empty ones; a null id stays null; repeated
    rows with a payload of at least 100 bytes are one response and revisits of it. An empty
    table gives an empty result.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, id_column, url_column, payload_column)
    found = store(read_payloads(spark, path), "payloads")
    kind = pages.schema[id_column].dataType
    named = found.where("record_type = 'response'").select(
        F.col("record_id").alias("_named"), F.col("page").alias("_page")
    )
    as_id = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return found.join(named, F.col("refers") == F.col("_named"), "left").select(
        as_id("page").alias(id_column),
        "payload_bytes",
        "payload_digest",
        "record_type",
        as_id("_page").alias("refers_to"),
    )
