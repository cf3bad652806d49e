"""Operator 8: a content-addressed WARC archive.

An archive is two tables in one folder. ``payloads`` holds every distinct
payload once under its SHA-256; ``headers`` holds each record's exact header
block and the SHA-256 of the payload it speaks of. Records are rebuilt by
joins: each payload goes to its response record, and what is reported is
measured on the rebuilt record. A revisit has no payload of its own; it takes
the measures of the response with the same digest.

Payload bytes move twice: to be stored once, and to their response record.
Everything else moves digests and ids.

Defined cases: a null html is the empty payload; a null url is written as an
empty target URI, and white space and control characters in one as %XX, so no
url can add a header line; of equal payloads the largest page_id is the response, and
of equal page_ids the first by url, so repeated rows give one response; a null
page_id sorts below all others; an empty table gives an empty archive; other
columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import materialise, shared_dir, table

CRLF = "\r\n"
#: Payloads below this size are not deduplicated.
MIN_DEDUP_BYTES = 0
DATE = "2024-01-01T00:00:00Z"


def base32_of_hex40(hexes: Column) -> Column:
    """Upper-case base 32 of a 40-digit hex string: five hex digits are four letters."""
    parts = [F.lpad(F.conv(F.substring(hexes, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def hashed(payload: Column) -> list[Column]:
    return [F.sha2(payload, 256).alias("sha256"), base32_of_hex40(F.sha1(payload)).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes")]


def one_line(url: Column) -> Column:
    """A url with white space and control characters percent-encoded; null becomes empty."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    safe = text
    for code in [*range(0x21), 0x7F]:
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(text.rlike(r"[\x00-\x20\x7F]"), safe).otherwise(text)


def _header(page: str, kind: Column, refers: Column) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), text(F.col(page)), F.lit(">"))),
        line("WARC-Target-URI", one_line(F.col("url"))),
        line("WARC-Date", F.lit(DATE)),
        F.when(kind == "revisit", line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.when(kind == "revisit", line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), text(refers), F.lit(">")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit(CRLF),
    ).cast("binary")


def write_archive(pages: DataFrame, folder: str, min_dedup_bytes: int = MIN_DEDUP_BYTES) -> None:
    """Write ``payloads`` and ``headers`` for the rows of (page_id, url, html)."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows.select("payload", *hashed(F.col("payload"))).groupBy("sha256").agg(
        F.first("payload").alias("payload"), F.first("digest").alias("digest"), F.first("n_bytes").alias("n_bytes")
    ).write.parquet(f"{folder}/payloads")

    slim = materialise(rows.select("page_id", "url", *hashed(F.col("payload"))), "warc-slim")
    order = F.struct(F.col("page_id").isNotNull(), F.col("page_id"))
    last = slim.groupBy("sha256").agg(F.max(order).alias("last"))
    marked = slim.join(last, "sha256")
    is_last = order.eqNullSafe(F.col("last"))
    # equal payloads under the same, largest page_id: only the first of them is the response
    tied = Window.partitionBy("sha256", "page_id").orderBy(F.col("url").isNull(), "url")
    lone = marked.filter(~is_last).withColumn("nth", F.lit(2))
    ends = marked.filter(is_last).withColumn("nth", F.row_number().over(tied))
    whole = lone.unionByName(ends)
    kind = F.when((F.col("n_bytes") < min_dedup_bytes) | (F.col("nth") == 1), F.lit("response")).otherwise(F.lit("revisit"))
    whole = whole.withColumn("kind", kind)
    whole.select("page_id", "url", "kind", "sha256", _header("page_id", F.col("kind"), F.col("last.page_id")).alias("header")).write.parquet(f"{folder}/headers")


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The header table with the fields parsed out of the exact header bytes."""
    text = F.decode(F.col("header"), "UTF-8")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    urn = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: <urn:page:([^>]*)>\r\n", 1), F.lit("")).cast("long")
    stored = spark.read.schema("page_id long, url string, kind string, sha256 string, header binary").parquet(f"{folder}/headers")
    return stored.select("header", "sha256", urn("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"), urn("WARC-Refers-To").alias("refers_to"), field("WARC-Payload-Digest").alias("stated"))


END = (CRLF * 2).encode()


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """Every record's exact bytes: its header, its payload (none for a revisit), two line ends.

    Only responses are joined with payloads, one to one but for payloads too
    small to be deduplicated, so no payload is copied to its revisits.
    """
    heads = read_headers(spark, folder)
    stored = spark.read.schema("sha256 string, payload binary, digest string, n_bytes long").parquet(f"{folder}/payloads")
    told = heads.filter("record_type = 'response'").join(stored.select("sha256", "payload"), "sha256", "left")
    again = heads.filter("record_type <> 'response'").withColumn("payload", F.lit(b""))
    both = told.unionByName(again)
    return both.select("page_id", "record_type", "refers_to", "sha256", "stated", "header", F.concat("header", F.coalesce("payload", F.lit(b"")), F.lit(END)).alias("record"))


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, with its payload as measured on the rebuilt records."""
    records = reconstruct(spark, folder)
    body = F.expr(f"substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - {len(END)})")
    measured = records.filter("record_type = 'response'").select("page_id", "record_type", "refers_to", "stated", "sha256", body.alias("body"))
    whole = measured.select("page_id", "record_type", "refers_to", "stated", F.col("sha256").alias("named"), *hashed(F.col("body")))
    whole = materialise(whole, "warc-responses")
    known = whole.groupBy("named").agg(F.first("sha256").alias("sha256"), F.first("digest").alias("digest"), F.first("n_bytes").alias("n_bytes"))
    revisits = read_headers(spark, folder).filter("record_type <> 'response'").withColumnRenamed("sha256", "named").drop("header")
    out = whole.unionByName(revisits.join(known, "named", "left").select(*whole.columns))
    good = F.coalesce((F.col("sha256") == F.col("named")) & (F.col("stated") == F.concat(F.lit("sha1:"), F.col("digest"))), F.lit(False))
    out = out.withColumn("digest", F.when(good, F.col("digest")).otherwise(F.raise_error(F.lit("a payload does not match its digest")).cast("string")))
    return out.select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return verified(spark, folder)


SQL = r"""
WITH hashed AS (
  SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
letters AS (
  SELECT *, list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, ((k // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (5 * (3 - k % 4))) & 31)::BIGINT, 1)) AS ls FROM hashed),
ranked AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, array_to_string(ls, '') AS payload_digest,
         row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST, url NULLS LAST) AS nth,
         max(page_id) OVER (PARTITION BY body) AS newest FROM letters)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN newest END AS refers_to
FROM ranked
"""
