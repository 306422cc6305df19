"""WARC archives: captures written by Spark's text writer, read back, and assembled by transaction.

Writing. Each page gives three records: a ``request``, a ``response`` (or a ``revisit`` if another page
has the same payload) and a ``metadata`` record; request and metadata name the response's record in
``WARC-Concurrent-To``. Among pages with equal payloads of at least ``least_bytes`` the one with
the greatest page_id is the response and the others revisit it. A record is text throughout (headers, then a UTF-8 payload), so
the text writer with a record's closing line ends as separator makes valid archives, gzipped, on any
file system that Spark can write to.

A capture's records are named by page, digest and row number, so equal rows are captures of their own. Pages are read twice (for the
digests, and to be written), and must come in the same order: a stored table.

Reading. Every archive is one row (its size is bounded by ``records_per_archive`` and ``SIZES``: about 200 MB, or one larger page);
a task walks through its records by their Content-Length, so no byte of a payload is taken for a boundary.

Assembly. Records of a capture are brought together by the record that they are concurrent to, and
each capture is one nested row.

Edge cases: a null html is an empty payload; a null url leaves WARC-Target-URI out, white space and
control characters of a url are percent-encoded; a null page_id is written as such and comes back
null; repeated rows are captures of their own, both responses if no greater page_id has the payload; an empty table gives no capture. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_BYTES = 0
RECORDS_PER_ARCHIVE = 3_000
#: Pages up to so many bytes share an archive of the usual number of records, larger ones of a part of it, so that an archive's bytes are bounded.
SIZES = [(1 << 16, 1), (1 << 22, 64), (1 << 62, 1_000)]
CAPTURED_AT = "2024-01-01T00:00:00Z"
SCHEME = "urn:capture:"

# The base32 alphabet and the profile of revisits by payload digest.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: four symbols for each five hex digits."""
    hexed = F.sha1(text.cast("binary"))
    parts = []
    for i in range(8):
        value = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def planned(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, row, payload, n_bytes, digest, original, original_row) of ``pages(page_id, url, html)``; original is the
    page_id of the response that a revisit refers to, and null for a response."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.monotonically_increasing_id().alias("row"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("n_bytes"), sha1_base32(F.col("payload")).alias("digest"))
    newest = rows.filter(F.col("n_bytes") >= least_bytes).groupBy("digest", "n_bytes").agg(F.max(F.struct("page_id", "row")).alias("newest"))
    joined = rows.join(newest, ["digest", "n_bytes"], "left")
    original = F.when(~F.col("page_id").eqNullSafe(F.col("newest.page_id")), F.col("newest"))
    return joined.withColumns({"original": original["page_id"], "original_row": original["row"]}).drop("newest")


def _record(kind: str, record_id: Column, fields: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {CAPTURED_AT}\r\nWARC-Record-ID: <"), record_id, F.lit(">\r\n")]
    for name, value in fields:
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    size = F.octet_length(block).cast("string")
    return F.concat(*head, F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), size, F.lit("\r\n\r\n"), block)


def records(plan: DataFrame) -> DataFrame:
    """(value): the text of every record."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    digest = F.col("digest")
    base = F.concat(F.lit(SCHEME), page, F.lit(":"), digest, F.lit(":"), F.col("row").cast("string"))
    own, about = F.concat(base, F.lit(":response")), [("WARC-Concurrent-To", F.concat(F.lit("<"), base, F.lit(":response>")))]
    clean = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    uri = [("WARC-Target-URI", clean)]
    host = F.coalesce(F.regexp_extract(clean, "^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(clean, "^[a-zA-Z]+://[^/?#]*([^#]*)", 1), F.lit(""))
    asked = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    named = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest))]
    refers = F.concat(F.lit(f"<{SCHEME}"), F.col("original").cast("string"), F.lit(":"), digest, F.lit(":"), F.col("original_row").cast("string"), F.lit(":response>"))
    answer = F.when(
        F.col("original").isNull(),
        _record("response", own, [*uri, *named], "application/http;msgtype=response", F.concat(http, F.col("payload"))),
    ).otherwise(
        _record("revisit", own, [*uri, *named, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", refers)], "application/http;msgtype=response", http)
    )
    request = _record("request", F.concat(base, F.lit(":request")), [*uri, *about], "application/http;msgtype=request", asked)
    facts = F.concat(F.lit("pageId: "), page, F.lit("\r\npayloadLength: "), F.col("n_bytes").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", F.concat(base, F.lit(":metadata")), [*uri, *about], "application/warc-fields", facts)
    return plan.select(F.explode(F.array(request, answer, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Archives of the pages, in passes by size of page; a pass reads and shuffles the payloads of its pages alone."""
    plan = planned(pages, least_bytes)
    size = F.octet_length(F.coalesce("html", F.lit("")))
    most = pages.agg(F.max(size)).first()[0] or 0
    below = -1
    for bound, part in SIZES:
        if below < most or below < 0:
            made = records(plan.filter((F.col("n_bytes") > below) & (F.col("n_bytes") <= bound)))
            writer = made.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip")
            writer.option("maxRecordsPerFile", max(records_per_archive // part, 1)).text(path)
        below = bound


def walk(data: bytes):
    """(headers with lower-case names, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} is not closed")
        at += 4


RECORD = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, content_type string, digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record. ``digest`` is the declared one; ``payload_bytes`` and ``payload_digest`` are of the payload that is there."""

    def bare(value):
        return value.strip("<>") if value else None

    def parse(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for headers, block in walk(gzip.decompress(data.as_py())):
                    kind = headers["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2] if "http" in headers["content-type"] else block
                    fields = None
                    if kind == "metadata":
                        lines = block.decode("utf-8").split("\r\n")
                        fields = [tuple(line.split(": ", 1)) for line in lines if line]
                    rows.append(
                        {
                            "record_type": kind,
                            "record_id": bare(headers["warc-record-id"]),
                            "concurrent_to": bare(headers.get("warc-concurrent-to")),
                            "refers_to": bare(headers.get("warc-refers-to")),
                            "target_uri": headers.get("warc-target-uri"),
                            "date": headers["warc-date"],
                            "content_type": headers["content-type"],
                            "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            "payload_bytes": len(payload),
                            "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None,
                            "fields": fields,
                            "payload": payload if with_payload else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in RECORD.split(", "))])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def captures(rows: DataFrame) -> DataFrame:
    """(capture, request, response, metadata): one nested row for each response or revisit and what is concurrent to it."""
    columns = [c for c in rows.columns if c not in ("concurrent_to", "fields")]
    whole = F.struct(*columns)
    about = F.col("record_type")
    fields = F.struct("record_id", *[F.col("fields")[k].alias(k) for k in ("pageId", "payloadLength")])
    return rows.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture")).agg(
        F.max(F.when(about == "request", whole)).alias("request"),
        F.max(F.when(about.isin("response", "revisit"), whole)).alias("response"),
        F.max(F.when(about == "metadata", fields)).alias("metadata"),
    )


def pages_of(assembled: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``captures``."""
    whole = F.col("response.record_type") == "response"
    number = F.regexp_extract("response.refers_to", f"^{SCHEME}([^:]+):", 1)
    return assembled.select(
        F.col("metadata.pageId").try_cast("long").alias("page_id"),
        F.when(whole, F.col("response.payload_bytes")).otherwise(F.col("metadata.payloadLength").cast("long")).alias("payload_bytes"),
        F.when(whole, F.col("response.payload_digest")).otherwise(F.col("response.digest")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        number.try_cast("long").alias("refers_to"),
    )


SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages
), g AS (
  SELECT *, CASE WHEN n >= {LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY x, n) ELSE page_id END AS newest FROM p
)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('{BASE32}',
    1 + ((('0x' || substr(x, 1 + 5 * (j // 4), 5))::BIGINT >> (15 - 5 * (j % 4))::BIGINT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM g
"""
