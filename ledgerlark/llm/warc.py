"""A content-addressed web archive.

An archive is two Parquet tables in a folder: ``payloads`` holds the bytes of every payload
once, under its SHA-256, and ``headers`` the exact header bytes of every WARC record, in the
order of its id, with the digest of its payload. A record is rebuilt by joining the two:
header, payload (for a response), and the two line ends that close a record. Reading verifies
every stored payload against its digest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.session import scratch_path

#: Equal payloads of at least that many bytes are stored as one response and revisits of it.
LEAST_REVISIT = 1000
_DATE = "1970-01-01T00:00:00Z"  # pages have no capture time
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(url: Column) -> Column:
    """A URL as a header value: no line ends, which would close the field."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]+", " ")


def record_id(page_id: Column, digest: Column) -> Column:
    """A record id from the page's id and its payload: equal on every run."""
    h = F.sha2(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("-")), digest), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Writes one record per row of ``pages`` (page_id, url, html). A null html is an empty
    payload. Of equal payloads of at least ``least`` bytes the row with the largest page_id is
    the response and the others revisit it; smaller payloads are all responses. Rows that
    repeat a page_id are records of their own with one id; rows without a page_id are
    responses. Other columns are ignored; an empty table gives an empty archive."""
    raw = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), _clean(F.col("url").cast("string")).alias("url"), raw.alias("payload"))
    keyed = src.withColumn("sha256", F.sha2("payload", 256))
    stored = keyed.groupBy("sha256").agg(F.first("payload").alias("payload"), F.max("page_id").alias("response_id"))
    stored = stored.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    stored.write.parquet(f"{path}/payloads")
    known = pages.sparkSession.read.parquet(f"{path}/payloads").select("sha256", "sha1", "bytes", "response_id")
    rows = keyed.select("page_id", "url", "sha256").join(known, "sha256")
    again = F.coalesce((F.col("bytes") >= least) & (F.col("page_id") != F.col("response_id")), F.lit(False))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", record_id(F.col("page_id"), F.col("sha256"))),
        line("WARC-Date", F.lit(_DATE)), line("WARC-Target-URI", F.col("url")), line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", record_id(F.col("response_id"), F.col("sha256"))),
                               line("X-Refers-To-Page-ID", F.col("response_id").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))), F.lit("\r\n"))
    headers = rows.select("page_id", "sha256", kind.alias("kind"), F.encode(block, "UTF-8").alias("header"))
    headers.write.parquet(f"{path}/headers")


def _field(name: str) -> Column:
    """A field's value in the header block."""
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, payload) of every stored payload; a payload that doesn't hash to its name stops the read."""
    got = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("sha256"))).cast("binary")
    return got.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(wrong))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, kind, record): the exact bytes of every record, header and payload joined."""
    head = spark.read.parquet(f"{path}/headers")
    body = F.when(F.col("kind") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.lit(b"\r\n\r\n")
    return head.join(read_payloads(spark, path), "sha256").select("page_id", "kind", F.concat("header", body, end).alias("record"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, from its
    header and the verified stored payload; the header's length and digest must be the payload's."""
    body = read_payloads(spark, path).select("sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    head = spark.read.parquet(f"{path}/headers").select(
        "sha256", _field("X-Page-ID").alias("id"), _field("WARC-Type").alias("record_type"), _field("WARC-Payload-Digest").alias("said"),
        _field("X-Payload-Length").alias("length"), _field("X-Refers-To-Page-ID").alias("refers"))
    agree = (F.col("said") == F.concat(F.lit("sha1:"), F.col("sha1"))) & (F.col("length") == F.col("bytes").cast("string"))
    digest = F.when(agree, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ for page "), F.col("id"))).cast("string"))
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return head.join(body, "sha256").select(number("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers").alias("refers_to"))


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archive (to a new folder under the shared checkpoint folder if none is named) and reads it back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, f"warc/{uuid.uuid4().hex}")
    write_archive(pages, path)
    return read_pages(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
k AS (SELECT page_id, octet_length(raw) AS n, sha1(raw) AS d, max(page_id) OVER (PARTITION BY raw) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM k
"""
