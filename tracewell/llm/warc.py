"""Content-addressed WARC archive.

Two tables hold an archive. ``payloads`` stores the bytes of every different payload once, as a
zlib stream under their SHA-256. ``headers`` keeps the exact WARC and HTTP header bytes of every
record with the key of its payload. Records are rebuilt by joining the two; each payload read is
hashed again and a wrong digest fails the job.

Of records with equal payloads of at least ``min_bytes`` the one with the largest id is a
response and the others are revisits of it; all others are responses.

Defined results: a null payload is empty, a null URI is left out of the header; rows that repeat
the largest id of a payload are all responses; a null id never is the one referred to unless all
are null, when every copy is a response.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bound_batches, map_batches, materialize

LEVEL = 3


def _payloads(pages: DataFrame) -> DataFrame:
    """Each different payload once, with the largest id that has it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), batch.column(0),
                pa.array(map(len, raw), pa.int64()), pa.array([hashlib.sha1(x).digest() for x in raw], pa.binary()),
                pa.array([zlib.compress(x, LEVEL) for x in raw], pa.binary()),
            ],
            ["payload_key", "id", "n_bytes", "sha1", "packed"],
        )

    rows = map_batches(pages, run, "payload_key binary, id long, n_bytes long, sha1 binary, packed binary")
    return rows.groupBy("payload_key").agg(F.max("id").alias("holder"), F.first("n_bytes").alias("n_bytes"), F.first("sha1").alias("sha1"), F.first("packed").alias("packed"))


def _header(kind: Column, page: Column, uri: Column, key: Column, sha1: Column, n: Column, holder: Column, date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit("\r\n\r\n"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(page)),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(uri, r"[\r\n]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.lower(F.hex(sha1)))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(holder)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(n)).cast("string")),
        F.lit("\r\n"),
        http,
    )


def archive(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """Write the ``headers`` and ``payloads`` tables to the shared folder and return both as read back."""
    bound_batches(pages.sparkSession)
    pages = pages.select(pages[id_col].cast("long").alias("id"), pages[text_col].cast("string").alias("text"), pages[uri_col].cast("string").alias("uri"))
    payloads = materialize(_payloads(pages.select("id", "text")), "warc-payloads")
    keys = pages.select("id", "uri", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("payload_key"))
    held = payloads.select("payload_key", "holder", "n_bytes", "sha1")
    kind = F.when((F.col("n_bytes") >= min_bytes) & (F.col("holder").isNotNull()) & ~F.col("id").eqNullSafe(F.col("holder")), "revisit").otherwise("response")
    headers = keys.join(held, "payload_key").select(
        F.col("id"), "payload_key", _header(kind, F.col("id"), F.col("uri"), F.col("payload_key"), F.col("sha1"), F.col("n_bytes"), F.col("holder"), date).cast("binary").alias("header")
    )
    return materialize(headers, "warc-headers"), payloads


def restore(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Original records: ``id``, ``header`` and full ``payload``, its digest verified.

    :func:`record_bytes` gives what a WARC file holds for a record.
    """
    bound_batches(headers.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, packed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            payload = zlib.decompress(packed)
            if hashlib.sha256(payload).digest() != key:
                raise ValueError(f"payload {key.hex()} is damaged")
            out.append(payload)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "header", "payload"])

    joined = headers.join(payloads.select("payload_key", "packed"), "payload_key").select("id", "header", "payload_key", "packed")
    return map_batches(joined, run, "id long, header binary, payload binary")


def field(header: Column, name: str) -> Column:
    """A field's value from header bytes; empty if it has none. Only a line feed ends a line, whatever a URI holds."""
    return F.regexp_extract(header.cast("string"), rf"(?md)^{name}: ([^\r\n]*)", 1)


def record_bytes(header: Column, payload: Column) -> Column:
    """A whole record as it stands in a WARC file; a revisit has no payload."""
    return F.concat(header, F.when(field(header, "WARC-Type") == "revisit", F.lit(b"")).otherwise(payload), F.lit(b"\r\n\r\n"))
