"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a request, a response (or a revisit of an earlier equal payload) and a metadata record. ``assemble``
joins the three through their WARC-Concurrent-To identifiers into one nested row per capture.

Defined cases: a null html is an empty payload; a null url becomes ``about:blank`` in the archive and null again when
read; a null page_id has no header and sorts after all others; of rows that tie on page_id and payload one is the
response and the rest revisit it; empty tables give empty archives; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import pinned, prepare
from canopy.session import new_path

CRLF = "\r\n"
#: Payloads below this many bytes never become revisits.
SMALLEST_REVISIT = 100
#: Pages per archive file, which bounds what a reader holds at once.
PAGES_PER_FILE = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, page_id long, "
    "payload_digest string, payload_bytes long, payload binary, block binary"
)


def _name(seed: str) -> F.Column:
    """A record id: a UUID-shaped name made from the row's key."""
    digest = F.md5(F.concat(F.lit(seed), F.col("_key")).cast("binary"))
    parts = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str, record_id: F.Column, headers: list[F.Column], block: F.Column) -> F.Column:
    """One record as text, without the blank lines that end it."""
    lines = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        *headers,
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_captures(pages: DataFrame, path: str) -> None:
    """Write three records per row of ``pages(page_id, url, html)`` as gzip-compressed archives under ``path``.

    The first row of every repeated payload is found from digests and ids alone; the payloads are shuffled once, by digest,
    to meet it. A digest that a third of all rows share meets one row there; as that side is written first, adaptive
    execution can split its rows.
    """
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select(
        "*",
        F.octet_length("html").cast("long").alias("bytes"),
        F.sha2(F.col("html").cast("binary"), 256).alias("digest"),
        F.monotonically_increasing_id().cast("string").alias("_key"),
    )
    first = pinned(
        rows.where(f"bytes >= {SMALLEST_REVISIT}")
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_key")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select(F.col("digest").alias("d"), "first")
    )
    rows = rows.join(first, F.col("digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & (F.col("first._key") != F.col("_key"))
    target = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\r\n]+", " "))
    page = F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    response_id, request_id, metadata_id = _name("response"), _name("request"), _name("metadata")
    beside = F.concat(F.lit("WARC-Concurrent-To: "), response_id)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes"), F.lit(CRLF * 2))
    of_first = F.md5(F.concat(F.lit("response"), F.col("first._key")).cast("binary"))
    first_id = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(of_first, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))
    answer = F.when(
        revisit,
        _record("revisit", response_id, [target, page, digest, F.lit(f"WARC-Profile: {REVISIT_PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), first_id), F.lit("Content-Type: application/http; msgtype=response")], http),
    ).otherwise(_record("response", response_id, [target, page, digest, F.lit("Content-Type: application/http; msgtype=response")], F.concat(http, F.col("html"))))
    ask = _record("request", request_id, [target, beside, F.lit("Content-Type: application/http; msgtype=request")], F.lit(f"GET / HTTP/1.1{CRLF}{CRLF}"))
    about = _record("metadata", metadata_id, [target, beside, F.lit("Content-Type: application/warc-fields")], F.concat(F.lit("payloadBytes: "), F.col("bytes"), F.lit(CRLF)))
    # The text writer ends every value with lineSep: the two blank lines that end a WARC record.
    (
        rows.select(F.explode(F.array(ask, answer, about)).alias("value"))
        .write.option("lineSep", CRLF * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 3 * PAGES_PER_FILE)
        .text(path)
    )


def parse(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """The records of one archive as (headers with lower-case names, block); lengths come from Content-Length."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        start = end + 4
        stop = start + int(headers["content-length"])
        yield headers, data[start:stop]
        at = stop + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path``: one row per record, the HTTP body of responses split off as ``payload``."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in RECORD.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                size = 0
                for headers, block in parse(content.as_py()):
                    kind = headers["warc-type"]
                    body = None
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        length = re.search(rb"(?i)content-length: *(\d+)", head)
                    page = headers.get("x-page-id")
                    uri = headers.get("warc-target-uri")
                    digest = headers.get("warc-payload-digest", "")
                    rows.append((
                        kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
                        None if uri == "about:blank" else uri, int(page) if page else None, digest.rpartition(":")[2] or None,
                        int(length[1]) if body is not None and length else None,
                        body if kind == "response" else None, None if body is not None else block,
                    ))
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``(capture_id, page_id, request, response, metadata)``.

    Requests and metadata name their response in WARC-Concurrent-To. A capture without one of them has null there.
    A join per record kind on the record id; ids are unique, so no group grows.
    """
    part = {kind: records.where(F.col("warc_type") == kind) for kind in ("request", "metadata")}
    main = records.where(F.col("warc_type").isin("response", "revisit"))
    out = main.select(
        F.col("record_id").alias("capture_id"), "page_id",
        F.struct("warc_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload").alias("response"),
    )
    for kind, rows in part.items():
        side = rows.select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target_uri", "block").alias(kind))
        out = out.join(side, "capture_id", "left")
    return out.select("capture_id", "page_id", "request", "response", "metadata")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and resolve the revisits.

    Returns ``(page_id, payload_bytes, payload_digest, record_type, refers_to, url)``. Digest and size of a response are
    taken from the payload read, those of a revisit from the response that it refers to.
    """
    spark = pages.sparkSession
    path = new_path(spark)
    write_captures(pages, path)
    of_payload = F.col("warc_type") == "response"
    records = read_records(spark, path).withColumns({
        "payload_digest": F.when(of_payload, F.sha2("payload", 256)),
        "payload_bytes": F.when(of_payload, F.octet_length("payload").cast("long")),
        "payload": F.lit(None).cast("binary"),
    })
    captures = assemble(pinned(records)).where("request is not null and metadata is not null").select("page_id", "response.*")
    first = captures.where("warc_type = 'response'").select(
        F.col("record_id").alias("_of"), F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")
    )
    plain = captures.where("warc_type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.col("target_uri").alias("url"))
    again = captures.where("warc_type = 'revisit'").join(first, F.col("refers_to") == F.col("_of")).select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("_page").alias("refers_to"), F.col("target_uri").alias("url"))
    return plain.union(again)
