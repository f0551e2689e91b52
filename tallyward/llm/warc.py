"""WARC archives: written by Spark's tasks, read back by a salvage reader.

Writing: one record per page, in WARC/1.1. Of records with equal payloads of 100 bytes or more, the one with the
smallest page_id is the response and the others revisit it. Spark's own text writer stores the records, so that a lost
executor's half-written archive never shows and any store will do. Archives are bounded by bytes: pages are written in
classes of size, each with as many records in an archive as keep it at ARCHIVE_BYTES or, for a class whose largest page
is SPREAD times the bound of the class below, at SPREAD times that.

Reading: one archive at a time, as one value, record by record; archives from elsewhere should be of some hundred MB at
most. A record counts when its version line, its headers, its length, its
closing blank lines and its block digest are all right. After a failed check the reader searches for the next version
line or gzip member that starts a right record, logs the bytes between as a quarantined gap, and goes on from there. A
record that ends where its headers say, but is damaged within, is passed over whole: what its page may hold is no record
of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small, stored, table

#: Fixed values of the format.
VERSION, END, GZIP = b"WARC/1.1\r\n", b"\r\n\r\n", b"\x1f\x8b\x08"
#: What headers end with: the empty line, or a version line if they are torn.
HEADERS_END = re.compile(re.escape(END) + b"|\r\n" + re.escape(VERSION))
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
LEAST_REVISIT_BYTES = 100
#: Bytes of pages in one archive, about, and the ratio of the bounds of two classes of size.
ARCHIVE_BYTES, SPREAD = 1 << 26, 4
#: Bytes of compressed data that is read at a time, and bytes that the headers of a gzip member may inflate to where the
#: archive itself is shorter (else as many as it has): a member that goes on without an end of headers is a damaged one.
CHUNK, MEMBER_HEADER_BYTES = 1 << 14, 1 << 24


def record_bytes(date: str) -> Column:
    """The record of a row (page_id, url, payload, digest, refers_to) as binary, without the last line feed.

    The URL's white space and control characters are percent-encoded, so that a header stays one line; null is left out.
    """
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    url = F.col("url")
    for code in (9, 10, 11, 12, 13, 32):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    revisit = F.col("refers_to").isNotNull()
    n = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(HTTP_OK + "Content-Length: "), n, F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    headers = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(f">\r\nWARC-Date: {date}\r\n"),
        line("WARC-Target-URI", url),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(block, 256), F.lit("\r\n"),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, f"WARC-Profile: {REVISIT_PROFILE}\r\n").otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(headers, block, F.lit("\r\n\r"))


def size_classes(mean: float, largest: int, archive_bytes: int = ARCHIVE_BYTES) -> list[tuple[float, float, int]]:
    """(above, up to, records per archive) in bytes of payload, from 0 to the largest: each class reaches SPREAD times further."""
    out, low, high = [], -1.0, max(float(mean) * SPREAD, 1024.0)
    while low < largest:
        out.append((low, high, max(1, int(archive_bytes * SPREAD / (high + 1024)))))
        low, high = high, high * SPREAD
    return out


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write pages (page_id, url, html; null html: empty) as WARC files under path.

    Only payloads that occur more than once are looked up again; a page whose payload is its own alone needs no join
    partner, and a group of copies is counted in its tasks before the shuffle. Rows that repeat the smallest page_id of
    their payload are responses, all of them.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    size = F.octet_length("payload")
    seen = keyed.where(size >= LEAST_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    several = stored(seen.where("n > 1").select("digest", "first_id"), "warc-copies")
    rows = keyed.join(small(several, 100_000), "digest", "left").withColumn("refers_to", F.when(F.col("first_id") != F.col("page_id"), F.col("first_id")))
    sizes = pages.select(F.octet_length("html").alias("n")).agg(F.avg("n"), F.max("n")).first()
    for low, high, records in size_classes(sizes[0] or 0.0, sizes[1] or 0, archive_bytes):
        own = rows.where((size > low) & (size <= high)).select(record_bytes(date).alias("value"))
        own.write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", records).text(path)


def parse_record(data: bytes, at: int) -> tuple[dict, bytes, int] | int | None:
    """Headers (lower-case names), block and end of the record at `at`.

    Headers may have any length: they end at the first empty line, and a version line before that, or a line that is no
    header, means they are torn. If whole headers say where the record ends, and it does end there, but another check
    fails, only that end is returned: what lies before it is this record's own, whatever it looks like. Else None.
    """
    if not data.startswith(VERSION, at):
        return None
    stop = HEADERS_END.search(data, at + len(VERSION) - 2)
    if not stop or stop[0] != END:
        return None
    head = stop.start()
    headers = {}
    for raw in data[at + len(VERSION) : head].split(b"\r\n"):
        name, colon, value = raw.partition(b":")
        if not colon or not name.strip():
            return None
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", headers.get("content-length", "")):
        return None
    start = head + len(END)
    end = start + int(headers["content-length"])
    if data[end : end + len(END)] != END:
        return None
    if "warc-type" not in headers or "warc-record-id" not in headers:
        return end + len(END)
    block = data[start:end]
    stated = headers.get("warc-block-digest", "")
    algorithm, _, value = stated.partition(":")
    if stated and (algorithm not in ("sha1", "sha256") or not digest_matches(hashlib.new(algorithm, block).digest(), value)):
        return end + len(END)
    return headers, block, end + len(END)


def digest_matches(own: bytes, stated: str) -> bool:
    return stated.lower() == own.hex() or stated == base64.b32encode(own).decode()


def stated_end(head: bytes, cut: int) -> int | None:
    """Where the record ends whose headers are head up to the empty line at cut; None if they don't say."""
    length = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r$", head[: cut + 2])
    return cut + 2 * len(END) + int(length[1]) if length else None


def inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The record in the gzip member at `at`, and where the member ends; None if the member is no whole record.

    A damaged member may go on as if whole far into what follows it; it is given up once it is longer than its record.
    """
    member, view, out, most, looked = zlib.decompressobj(31), memoryview(data), bytearray(), None, 0
    fed = b""
    try:
        while not member.eof:
            if not fed:
                if at >= len(data):
                    return None
                fed, at = view[at : at + CHUNK], min(at + CHUNK, len(data))
            out += member.decompress(fed, CHUNK)
            fed = member.unconsumed_tail
            if most is None:
                cut, looked = out.find(END, looked), max(0, len(out) - len(END) + 1)
                if cut >= 0 and (most := stated_end(bytes(out[: cut + len(END)]), cut)) is None:
                    return None
            if not out.startswith(VERSION[: len(out)]) or len(out) > (max(MEMBER_HEADER_BYTES, len(data)) if most is None else most):
                return None
    except zlib.error:
        return None
    return bytes(out), at - len(member.unused_data)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict, bytes]]:
    """("record", start, end, headers, block) and ("gap", start, end, {}, b"") over one archive, in order, leaving out no byte."""
    at, bad = 0, None
    starts = re.compile(re.escape(VERSION) + b"|" + re.escape(GZIP))
    while at < len(data):
        found, passed = None, None
        if data.startswith(GZIP, at):
            if member := inflate(data, at):
                inner, passed = parse_record(member[0], 0), member[1]
                if isinstance(inner, tuple) and inner[2] == len(member[0]):
                    found = (inner[0], inner[1], member[1])
        else:
            found = parse_record(data, at)
            if isinstance(found, int):
                found, passed = None, found
        if found:
            if bad is not None:
                yield "gap", bad, at, {}, b""
                bad = None
            yield "record", at, found[2], found[0], found[1]
            at = found[2]
        else:
            bad = at if bad is None else bad
            # a record or member that ends where it says is passed over as a whole, so nothing within it is taken for one
            m = starts.search(data, passed or at + 1)
            at = m.start() if m else len(data)
    if bad is not None:
        yield "gap", bad, len(data), {}, b""


READ = "archive string, kind string, start bigint, end bigint, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap (kind "gap") of the archives under path.

    payload_bytes of a revisit is the length that its HTTP headers state; without payloads the column is null.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                out = []
                for kind, start, end, headers, block in salvage(data):
                    http, _, payload = block.partition(END)
                    stated = re.search(rb"(?im)^content-length:\s*([0-9]{1,18})", http)
                    revisit = headers.get("warc-type") == "revisit"
                    n = (int(stated[1]) if stated else None) if revisit else len(payload)
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    if kind == "record" and not revisit:
                        digest = hashlib.sha256(payload).hexdigest()
                    out.append((name, kind, start, end, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), digest, n if kind == "record" else None, payload if payloads and kind == "record" else None))
                    if len(out) == 1000:
                        yield frame(out)
                        out = []
                if out:
                    yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ")])
        return df.astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, READ)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, from the archives as read back. Empty and null html are payloads of 0 bytes.

    A page without page_id is a response record under no number, and gets a null back. The archives written here are
    whole, so nothing is quarantined; damaged_pages reads damaged ones. URLs may have any length.
    """
    path = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    records = read_archives(spark, path, payloads=False).where("kind = 'record'")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to"))


def damaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, readable) of the pages, from archives in which every page of a number divisible by 7 was damaged.

    A damaged record has another block digest than its header states; the reader salvages all the others, whatever lies
    between, and reports each run of damaged ones as a gap. A page without page_id is never damaged; it is readable, under
    a null. Pages that share a page_id are a row each.
    """
    path = shared_dir(spark, "warc-damaged")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumns({"digest": F.sha2("payload", 256), "refers_to": F.lit(None).cast("bigint")})
    record = record_bytes("2024-01-01T00:00:00Z")
    stated = F.concat(F.lit("WARC-Block-Digest: sha256:"), F.lit("0" * 64))
    damaged = F.regexp_replace(record.cast("string"), "WARC-Block-Digest: sha256:[0-9a-f]{64}", stated)
    sizes = pages.agg(F.avg(F.octet_length("payload")), F.max(F.octet_length("payload"))).first()
    records = size_classes(sizes[0] or 0.0, sizes[1] or 0)[-1][2]
    pages.select(F.when(F.col("page_id") % 7 == 0, damaged).otherwise(record).alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", records).text(path)
    found = read_archives(spark, path, payloads=False)
    page = F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    read = found.where("kind = 'record'").select(page.alias("page_id"), F.lit(True).alias("readable"))
    seen = read.select(F.col("page_id").alias("seen")).distinct()
    lost = pages.select("page_id").join(seen, F.col("page_id").eqNullSafe(F.col("seen")), "left_anti").select("page_id", F.lit(False).alias("readable"))
    return read.unionAll(lost)


DAMAGED_SQL = "SELECT page_id, coalesce(page_id % 7 <> 0, true) AS readable FROM pages"
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
