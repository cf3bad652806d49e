import base64
import hashlib
import uuid

import pytest

from tallyspark.llm import warc as W
from tallyspark.llm.common import shared_dir

PAGES = [
    (1, "http://a", "<p>x"), (2, "http://b", "<p>x"), (3, "http://c", None), (4, None, ""), (5, "http://e", "é日😀" * 1000), (6, "http://f", "<p>x"), (6, "http://f", "<p>x"), (7, "http://g", "solo"), (None, "http://h", "<p>x"), (None, None, "lost"),
]


@pytest.fixture
def archive(spark):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    W.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), folder)
    return folder


def test_measures(spark, archive):
    rows = sorted(map(tuple, W.verified(spark, archive).collect()), key=str)
    want = []
    newest: dict = {}
    for p, _, h in PAGES:
        newest[h or ""] = max(newest.get(h or "", -1), -1 if p is None else p)
    seen = set()
    for p, _, h in PAGES:
        body = (h or "").encode()
        first = (-1 if p is None else p) == newest[h or ""] and (h or "") not in seen
        seen |= {h or ""} if first else set()
        want.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else newest[h or ""]))
    assert rows == sorted(want, key=str)


def test_records_come_back_and_payloads_are_stored_once(spark, archive):
    records = W.reconstruct(spark, archive).collect()
    assert len(records) == len(PAGES)
    texts = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in PAGES}
    for r in records:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        assert body == (texts[r.sha256] if r.record_type == "response" else b"") + b"\r\n\r\n"
    assert spark.read.parquet(f"{archive}/payloads").count() == len(texts)


def test_hostile_urls_add_no_header_line(spark):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    urls = ["http://a/\r\nWARC-Payload-Digest: x", "\r\nWARC-Refers-To: <urn:page:zz>\r\n", "http://b/\n\x00 \x7f\t", "\r\n\r\n"]
    pages = spark.createDataFrame([(i, u, "same", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, digest string")
    W.write_archive(pages, folder)
    rows = {r.page_id: r for r in W.verified(spark, folder).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in rows.items()} == {0: ("revisit", 3), 1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None)}
    heads = [bytes(r.record).partition(b"\r\n\r\n")[0].decode() for r in W.reconstruct(spark, folder).collect()]
    assert "WARC-Target-URI: http://a/%0D%0AWARC-Payload-Digest:%20x" in "".join(heads)
    assert all(h.count("WARC-Payload-Digest: ") == 1 for h in heads)


def test_a_spoiled_payload_is_found(spark, archive):
    from pyspark.sql import functions as F

    other = f"{archive}-spoiled"
    spark.read.parquet(f"{archive}/headers").write.parquet(f"{other}/headers")
    spark.read.parquet(f"{archive}/payloads").withColumn("payload", F.when(F.col("n_bytes") == 4, F.lit(b"evil")).otherwise(F.col("payload"))).write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="does not match"):
        W.verified(spark, other).collect()


def test_small_payloads_can_be_left_alone(spark):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    W.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), folder, min_dedup_bytes=100)
    assert {r.record_type for r in W.verified(spark, folder).collect()} == {"response"}


def test_empty(spark):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    W.write_archive(spark.createDataFrame([], "page_id long, url string, html string, digest string"), folder)
    assert W.verified(spark, folder).count() == 0
