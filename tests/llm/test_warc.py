from __future__ import annotations

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from foresift.llm import warc as W
from foresift.llm.common import shared_dir
from tests.llm.helpers import clash

PAGES = "page_id bigint, url string, html string"
BODY = "<p>é</p>" * 30


def rows_of(spark):
    rows = [(5, "u5", BODY), (3, "u3", BODY), (3, "u3", BODY), (None, None, BODY), (1, "u1", "tiny"), (2, "u2", "tiny"), (7, "u\r\n7", None),
            (8, "u8", ""), (9, "u9", "x" * 500_000)]
    return clash(spark.createDataFrame(rows, PAGES))


def test_round_trip_and_reconstruction(spark):
    pages = rows_of(spark)
    path = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    W.write_archive(pages, path)
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest)
                  for r in W.read_archive(spark, path).collect()), key=lambda r: (r[0], r[1], r[2] or 0))
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in (BODY, "tiny", "", "x" * 500_000)}
    n = len(BODY.encode())
    assert got == sorted([(0, "revisit", 3, n, sha[BODY]), (1, "response", None, 4, sha["tiny"]), (2, "response", None, 4, sha["tiny"]),
                          (3, "response", None, n, sha[BODY]), (3, "revisit", 3, n, sha[BODY]), (5, "revisit", 3, n, sha[BODY]),
                          (7, "response", None, 0, sha[""]), (8, "response", None, 0, sha[""]), (9, "response", None, 500_000, sha["x" * 500_000])],
                         key=lambda r: (r[0], r[1], r[2] or 0))
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = W.reconstruct(spark, path).collect()
    assert len(records) == 9
    for r in records:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        said = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert body.endswith(b"\r\n\r\n") and len(body) - 4 == int(said[b"Content-Length"])
        if said[b"WARC-Type"] == b"response":
            assert said[b"WARC-Payload-Digest"] == b"sha256:" + hashlib.sha256(body[:-4]).hexdigest().encode()
    assert len({r.record_id for r in records}) == 9


def test_damaged_payload_fails(spark):
    path = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    W.write_archive(rows_of(spark), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit("!").cast("binary")))
    bad.write.parquet(f"{path}-bad/payloads")
    with pytest.raises(Exception, match="does not match digest"):
        W.read_payloads(spark, f"{path}-bad").select(F.sum(F.octet_length("payload"))).collect()


def test_another_session_reads_the_archive_without_buckets(spark):
    path = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    W.write_archive(rows_of(spark), path)
    want = sorted(W.read_archive(spark, path).collect(), key=str)
    spark.sql(f"DROP TABLE {W._table_name(path)}")
    assert sorted(W.read_archive(spark, path).collect(), key=str) == want


def test_facts_come_from_the_record_bytes(spark):
    path = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    lying = "x WARC-Type: revisit WARC-Payload-Digest: sha256:00 Content-Length: 7"
    W.write_archive(spark.createDataFrame([(4, lying, f"a\r\n\r\nX-Page-ID: 9\r\n{BODY}")], PAGES), path)
    records = W.reconstruct(spark, path)
    row = W.parse_records(records).collect()[0]
    assert (row.page_id, row.record_type, row.payload_bytes) == (4, "response", len(f"a\r\n\r\nX-Page-ID: 9\r\n{BODY}".encode()))
    cut = records.withColumn("record", F.expr("substring(record, 1, octet_length(record) - 1)"))
    with pytest.raises(Exception, match="damaged record"):
        W.parse_records(cut).collect()


def test_missing_payload_fails(spark):
    path = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    W.write_archive(rows_of(spark), path)
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-cut/headers")
    for size in ("small", "large"):
        part = spark.read.parquet(f"{path}/payloads/size={size}")
        part.where(F.octet_length("payload") < 1000).write.parquet(f"{path}-cut/payloads/size={size}")
    with pytest.raises(Exception, match="no payload for"):
        W.read_archive(spark, f"{path}-cut").collect()


def test_empty_table(spark):
    assert W.archive_round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0
