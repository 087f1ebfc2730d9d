"""Content-addressed WARC archive.

Two Parquet tables: `payloads` holds each distinct payload once under its SHA-256, `headers` holds the exact header
bytes of every record and the SHA-256 of its payload. A join gives the original records back; each payload is
hashed again on the way, and a mismatch is an error.

A null html is an empty payload; a null url leaves out WARC-Target-URI, a null page_id WARC-Page-ID, and both read
back as null; an empty url is an empty field and reads back as such. A url with control characters, which would end the
field, is percent-encoded there and stands in hex digits beside it, from where it reads back as it was. Of equal payloads of at least min_bytes the record with the largest (page_id, url) is the response,
nulls counting as smallest; rows that repeat exactly are records of their own, of which one at most is the response.
Empty tables give empty archives; further columns of pages aren't archived.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Pages a WARC file holds on export.
FILE_RECORDS = 2000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hex digits are 4 base32 digits."""
    digits = []
    for i in range(8):
        part = F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(part, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


CONTROL = r"[\x00-\x1F\x7F]"


def _encoded(url: Column) -> Column:
    """url with its control characters percent-encoded."""
    one = lambda c: F.when(c.rlike(CONTROL), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)
    return F.when(url.rlike(CONTROL), F.array_join(F.transform(F.split(url, ""), one), "")).otherwise(url)


def record_id(page_id: Column, url: Column, copy: Column) -> Column:
    h = F.md5(F.to_json(F.struct(page_id.alias("p"), url.alias("u"), copy.alias("c"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if i > 1 else ()) + (F.substring(h, i, n),)], F.lit(">"))


def archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes path/payloads and path/headers of pages(page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    rows.groupBy("sha256").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    meta = rows.select("page_id", "url", "sha256", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    counted = meta.groupBy("page_id", "url", "sha256", "sha1", "bytes").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    best = meta.where(F.col("bytes") >= min_bytes).groupBy("sha256").agg(F.max(F.struct("page_id", "url")).alias("best"))
    found = counted.join(best, "sha256", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    is_best = (F.col("copy") == 0) & F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url"))
    revisit = (F.col("bytes") >= min_bytes) & ~is_best
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("copy"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _encoded(F.col("url"))),
        _line("WARC-Target-URI-Hex", F.when(F.col("url").rlike(CONTROL), F.hex(F.col("url").cast("binary")))),
        _line("WARC-Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(revisit, record_id(F.col("best.page_id"), F.col("best.url"), F.lit(0)))),
        _line("WARC-Refers-To-Page-ID", F.when(revisit, F.col("best.page_id").cast("string"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit(CRLF),
        F.col("http"),
    )
    found.withColumn("http", http).select("sha256", head.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """header, payload (binary) of every record; the payload also for revisits, from the record that they refer to."""
    headers = spark.read.schema("sha256 string, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    ok = F.sha2("payload", 256) == F.col("sha256")
    checked = payloads.withColumn("payload", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload differs from its digest")).cast("binary")))
    return headers.join(checked, "sha256").select("header", "payload")


def field(header: Column, name: str) -> Column:
    """A field of the WARC header, which may be empty; null if it has none."""
    return F.get(F.regexp_extract_all(header.cast("string"), F.lit(f"(?s)\\A(?:(?!\r\n\r\n).)*?\r\n{name}: ([^\r\n]*)\r\n"), F.lit(1)), F.lit(0))


def describe(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of restored records."""
    h = F.col("header")
    return records.select(
        field(h, "WARC-Page-ID").cast("long").alias("page_id"),
        F.coalesce(F.unhex(field(h, "WARC-Target-URI-Hex")).cast("string"), field(h, "WARC-Target-URI")).alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        field(h, "WARC-Type").alias("record_type"),
        field(h, "WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
    )


def export_warc(records: DataFrame, path: str) -> None:
    """Restored records as WARC files: a record ends with two CRLF, revisits carry no payload."""
    body = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit("")).otherwise(F.decode("payload", "utf-8"))
    out = records.select(F.concat(F.decode("header", "utf-8"), body).alias("value"))
    out.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_warc(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(WARC header with its blank line, block) of each record of a file, by Content-Length."""
    at = 0
    while (end := content.find(b"\r\n\r\n", at)) >= 0:
        end += 4
        size = next(int(x.split(b":")[1]) for x in content[at:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield content[at:end], content[end : end + size]
        at = end + size + 4


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """warc (binary), block (binary) of each record in the WARC files under path."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b.content:
                yield pd.DataFrame(parse_warc(content), columns=["warc", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "warc binary, block binary")
