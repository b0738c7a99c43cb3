"""WARC: pages written as captures of three records, read back and assembled through WARC-Concurrent-To.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record. The writer is
Spark's text sink: a record ends with two CRLFs, which is the sink's line separator. The reader parses by
Content-Length, so payloads may hold anything, and unpacks gzip as a stream.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, batch, id_key, scratch, table

CRLF = "\r\n"
#: Payloads of fewer bytes are always written whole.
MIN_REVISIT = 100
#: Fixed date of the capture, so that a page always gives the same archive.
DATE = "2024-01-01T00:00:00Z"
#: Captures a file at most, which bounds what a reading task holds.
CAPTURES_A_FILE = 20_000
#: Parts that the pages of one payload are dealt into; one bit of a long for each.
PARTS = 64


def record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A WARC record without the two CRLFs that end it."""
    length = F.octet_length(block).cast("string")
    parts: list[Column] = [F.lit("WARC/1.1" + CRLF)]
    for name, value in headers:
        parts += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))]
    return F.concat(*parts, F.lit("Content-Length: "), length, F.lit(CRLF + CRLF), block)


def mark_revisits(pages: DataFrame) -> DataFrame:
    """pages with __payload, __bytes, __digest and __first, the smallest page_id of the equal payloads of at least MIN_REVISIT bytes (null for small ones, and for a payload that one row has).

    Pages of one payload are dealt into parts by page_id and url, so that a payload of very many pages, the empty one too, is no single task's.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("__payload"), F.octet_length(payload).cast("long").alias("__bytes"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("__digest"))
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), part)
    # Partial sums keep a frequent payload to a row a task; a payload that repeats is joined back once for each part it has pages in.
    firsts = rows.where(F.col("__bytes") >= MIN_REVISIT).groupBy("__digest").agg(F.min(F.coalesce("page_id", F.lit(NULL_ID))).alias("__first"), F.count("*").alias("__n"), F.bit_or(bit).alias("__parts")).where("__n > 1")
    held = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.getbit("__parts", i) == 1)
    return rows.withColumn("__part", part).join(firsts.select("__digest", "__first", F.explode(held).alias("__part")), ["__digest", "__part"], "left").drop("__part")


def captures(pages: DataFrame) -> DataFrame:
    """One string column: the three records of each page."""
    rows = mark_revisits(pages)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    name = lambda who, kind: F.concat(F.lit("<urn:page:"), who, F.lit(":"), F.col("__digest"), F.lit(f":{kind}>"))
    capture = name(page, "capture")
    revisit = F.coalesce(F.col("__first") != id_key("page_id"), F.lit(False))
    uri = F.regexp_replace(F.coalesce("url", F.lit("urn:unknown")), "[\\x00-\\x20\\x7f]", "%20")
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri)]
    digest = F.concat(F.lit("sha256:"), F.col("__digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("__bytes").cast("string"), F.lit(CRLF + CRLF))
    first = name(F.when(F.col("__first") == NULL_ID, F.lit("none")).otherwise(F.col("__first").cast("string")), "capture")
    request = record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", name(page, "request")), *common, ("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/http; msgtype=request"))], F.lit(f"GET / HTTP/1.1{CRLF}Accept: text/html{CRLF}{CRLF}"))
    response = record([("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", capture), *common, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.when(revisit, first)), ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.when(revisit, "").otherwise(F.col("__payload"))))
    metadata = record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", name(page, "metadata")), *common, ("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page: "), page, F.lit(f"{CRLF}payload-bytes: "), F.col("__bytes").cast("string"), F.lit(CRLF)))
    return rows.select(F.concat_ws(CRLF + CRLF, request, response, metadata).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Archives of the pages (page_id, url, html; a null html is an empty payload, a null url urn:unknown) under path, gzipped. Repeated rows are written each time; an equal page_id and payload is no revisit of itself."""
    captures(pages).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", CAPTURES_A_FILE).text(path)


class Stream:
    """The bytes of a gzip member or of plain bytes, a piece at a time."""

    def __init__(self, content: bytes):
        self.raw, self.at, self.held = memoryview(content), 0, bytearray()
        self.gz = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        piece = self.raw[self.at : self.at + (1 << 18)]
        self.at += len(piece)
        if self.gz is None:
            self.held += piece
            return True
        self.held += self.gz.decompress(piece)
        while self.gz.eof and (rest := self.gz.unused_data):  # one member a record is usual too
            self.gz = zlib.decompressobj(31)
            self.held += self.gz.decompress(rest)
        return True

    def line(self) -> bytes | None:
        start = 0
        while (end := self.held.find(b"\n", start)) < 0:
            start = len(self.held)
            if not self.more():
                if not self.held:
                    return None
                end = len(self.held) - 1
                break
        out = bytes(self.held[: end + 1])
        del self.held[: end + 1]
        return out.rstrip(b"\r\n")

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        if len(self.held) < n:
            raise ValueError("a WARC record is shorter than its Content-Length")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record."""
    stream = Stream(content)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers = {}
        while line := stream.line():
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode()
        yield headers, stream.take(int(headers.get("content-length", 0)))


RECORDS = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("header_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.string()), ("payload", pa.string())])
RECORD_TYPES = "warc_type string, record_id string, concurrent_to string, target_uri string, date string, refers_to string, header_digest string, payload_bytes long, payload_digest string, fields string, payload string"


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record. The payload (what follows the HTTP headers) is measured and digested where it is read, and kept only if asked for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                held: list[tuple] = []
                size = 0
                for h, block in parse(content.as_py()):
                    kind = h.get("warc-type")
                    payload = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit") else None
                    held.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), h.get("warc-payload-digest"), None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest(), block.decode("utf-8", "replace") if kind == "metadata" else None, payload.decode("utf-8", "replace") if with_payload and payload is not None else None))
                    size += len(block) if with_payload else 0
                    if len(held) >= 5000 or size > 8_000_000:
                        yield batch(RECORDS, **{n: [r[i] for r in held] for i, n in enumerate(RECORDS.names)})
                        held, size = [], 0
                yield batch(RECORDS, **{n: [r[i] for r in held] for i, n in enumerate(RECORDS.names)})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, RECORD_TYPES)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit: request and metadata are the records that are concurrent to it.

    A capture without one of them has a null there; of several the smallest record id counts. A record that
    names no capture, or one that is not there, gives no row. Record ids are all but unique, so no key is frequent.
    """
    of = lambda kind: records.where(F.col("warc_type") == kind)
    request = of("request").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct("record_id", "target_uri", "date")).alias("request"))
    metadata = of("metadata").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct("record_id", "fields")).alias("metadata"))
    response = records.where(F.col("warc_type").isin("response", "revisit")).select("record_id", F.struct("record_id", "warc_type", "target_uri", "date", "refers_to", "header_digest", "payload_bytes", "payload_digest", "payload").alias("response"))
    return response.join(request, "record_id", "left").join(metadata, "record_id", "left").select(F.col("record_id").alias("capture_id"), "request", "response", "metadata")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives into the shared folder, reads them back and reports what they hold. A revisit's bytes and digest are those of the full payload, from its metadata record and its digest header; a response's are counted from the block read, and a response whose digest isn't the header's fails the query."""
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    rows = assemble(read(spark, path))
    page_of = lambda name: F.regexp_extract(name, "^<urn:page:(-?[0-9]+):", 1)
    revisit = F.col("response.warc_type") == "revisit"
    digest = F.substring("response.header_digest", 8, 64)
    sound = F.when(revisit | (digest == F.col("response.payload_digest")), digest).otherwise(F.raise_error(F.lit("a payload differs from its digest")).cast("string"))
    return rows.select(
        F.nullif(page_of(F.col("capture_id")), F.lit("")).cast("long").alias("page_id"), F.when(revisit, F.regexp_extract("metadata.fields", "payload-bytes: ([0-9]+)", 1).cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"), sound.alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"), F.nullif(page_of(F.col("response.refers_to")), F.lit("")).cast("long").alias("refers_to"),
    )


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_page FROM d WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN first_page <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_page <> d.page_id THEN first_page END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= {MIN_REVISIT}"""
