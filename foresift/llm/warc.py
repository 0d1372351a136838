"""Content-addressed WARC archive (operator 8).

Each record is split in two: its exact header bytes go to the `headers` table, its payload goes once per SHA-256 digest to the
`payloads` table. `reconstruct` verifies every stored payload against its digest and joins the two back to the original record
bytes; `read_archive` takes everything it reports from those bytes. Of records with equal payloads of at least
`min_revisit_bytes`, the first (smallest page_id) is a `response` and the others are `revisit` records that name it; smaller
payloads are always responses.

Payloads are combined before their only shuffle, so a task sends a payload once. Large ones are stored in buckets of their digest:
each has one response, so headers come to the payloads, which stay where they are. Small payloads may have any number of responses
and lie apart, for a join whose large partitions adaptive execution splits; so does the join of revisits with what they revisit.
A session that did not write the archive does not know the buckets and shuffles payloads once.

Defined cases: a null html is an empty payload; a null page_id sorts last and has no page line in its header; repeated rows each
get a record, and exactly one of equal first rows is the response; a null url gives an empty target URI; line ends in a url or an
id are left out; extra columns are ignored; an empty table gives an empty archive.
"""
from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foresift.llm.common import materialise, shared_dir

CRLF = "\r\n"
HEADERS = ("record_id", "record_type", "payload_digest", "large", "header")


def _one_line(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"[\r\n]", "")


def _record_id(row: Column) -> Column:
    """A name for the record from its place in the input."""
    h = F.md5(F.concat_ws(":", row.cast("string")).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def _header(date: str) -> Column:
    """The exact header block of a record, up to and with the empty line."""
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <"), F.col("record_id"), F.lit(">")), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("X-Page-ID: "), _one_line(F.col("page_id"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), F.col("first_record"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2))


def _table_name(path: str) -> str:
    return f"warc_payloads_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes `<path>/headers` (a row per record) and `<path>/payloads` (a row per distinct payload, by size)."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", _one_line(F.coalesce(F.col("url").cast("string"), F.lit(""))).alias("url"),
                        F.sha2(body, 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"),
                        F.monotonically_increasing_id().alias("row_id"))
    rows = materialise(rows)                    # both sides of the join below must see the same row numbers
    order = F.struct(F.col("page_id").isNull().alias("late"), F.col("page_id"), F.col("row_id"))
    first = rows.groupBy("payload_digest").agg(F.min(order).alias("first"))
    large = F.col("payload_bytes") >= min_revisit_bytes
    tagged = rows.join(first, "payload_digest") \
        .withColumn("record_type", F.when(large & (F.col("row_id") != F.col("first.row_id")), "revisit").otherwise("response")) \
        .withColumn("record_id", _record_id(F.col("row_id"))).withColumn("large", large) \
        .withColumn("first_record", _record_id(F.col("first.row_id")))
    tagged.withColumn("header", _header(date).cast("binary")).select(*HEADERS).write.parquet(f"{path}/headers")

    def payloads(which):
        return pages.where(which).select(F.sha2(body, 256).alias("payload_digest"), body.alias("payload")) \
            .groupBy("payload_digest").agg(F.first("payload").alias("payload"))

    size = F.octet_length(body)
    payloads(size < min_revisit_bytes).write.parquet(f"{path}/payloads/size=small")
    buckets = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    payloads(size >= min_revisit_bytes).write.format("parquet").bucketBy(buckets, "payload_digest") \
        .option("path", f"{path}/payloads/size=large").saveAsTable(_table_name(path))


def _verified(stored: DataFrame) -> DataFrame:
    ok = F.sha2("payload", 256) == F.col("payload_digest")
    return stored.select("payload_digest", F.when(ok, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("payload_digest"))).cast("binary")).alias("payload"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads; a payload that does not have its digest fails the job."""
    return _verified(spark.read.parquet(f"{path}/payloads"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type and the bytes of each original record; revisits carry no payload."""
    heads = spark.read.schema("record_id string, record_type string, payload_digest string, large boolean, header binary") \
        .parquet(f"{path}/headers")
    name, folder = _table_name(path), f"{path}/payloads/size="
    large = spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(f"{folder}large")
    end = F.lit(CRLF * 2).cast("binary")

    def records(which, stored):
        whole = F.when(F.col("payload").isNotNull(), F.concat("header", "payload", end)).otherwise(
            F.raise_error(F.concat(F.lit("no payload for "), F.col("record_id"))).cast("binary"))
        return heads.where(which).join(_verified(stored), "payload_digest", "left").select("record_id", "record_type", whole.alias("record"))

    response = F.col("record_type") == "response"
    revisits = heads.where(~response).select("record_id", "record_type", F.concat("header", end).alias("record"))
    return records(response & F.col("large"), large).unionByName(records(response & ~F.col("large"), spark.read.parquet(f"{folder}small"))) \
        .unionByName(revisits)


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)\r\n", 1)


def parse_records(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """What each record says of itself: ids, type, the record it refers to, its digest and the length of its body.

    A body that has not the length its header states, or of a response not its digest, fails the job.
    """
    head = F.substring_index(F.col("record").cast("string"), CRLF * 2, 1)
    rows = records.withColumn("head", F.concat(head, F.lit(CRLF)))
    body = F.expr("substring(record, octet_length(head) + 3, octet_length(record) - octet_length(head) - 6)")
    rows = rows.select("head", F.octet_length(body).cast("long").alias("n"), F.sha2(body, 256).alias("found"))
    said = rows.select(F.regexp_extract(_field("WARC-Record-ID"), "<(.*)>", 1).alias("record_id"), _field("WARC-Type").alias("record_type"),
                       F.nullif(_field("X-Page-ID"), F.lit("")).cast(id_type).alias("page_id"),
                       F.regexp_extract(_field("WARC-Refers-To"), "<(.*)>", 1).alias("first_record"),
                       F.regexp_extract(_field("WARC-Payload-Digest"), "sha256:(.*)", 1).alias("payload_digest"),
                       _field("Content-Length").cast("long").alias("length"), "n", "found")
    whole = (F.col("length") == F.col("n")) & ((F.col("record_type") == "revisit") | (F.col("found") == F.col("payload_digest")))
    size = F.when(whole, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))).cast("long"))
    return said.select("record_id", "record_type", "page_id", "first_record", "payload_digest", size.alias("payload_bytes"))


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """A row per record from its rebuilt bytes; the page and the payload of a revisit are those of the record that it names."""
    said = materialise(parse_records(reconstruct(spark, path), id_type))
    responses = said.where("record_type = 'response'")
    named = responses.select(F.col("record_id").alias("first_record"), F.col("page_id").alias("refers_to"),
                             F.col("payload_digest").alias("first_digest"), F.col("payload_bytes").alias("first_bytes"))
    size = F.when(F.col("first_digest") == F.col("payload_digest"), F.col("first_bytes")).otherwise(
        F.raise_error(F.concat(F.lit("nothing to revisit for "), F.col("record_id"))).cast("long"))
    revisits = said.where("record_type = 'revisit'").drop("payload_bytes").join(named, "first_record", "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    return responses.withColumn("refers_to", F.lit(None).cast(id_type)).select(*out) \
        .unionByName(revisits.withColumn("payload_bytes", size).select(*out))


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return read_archive(spark, path, pages.schema["page_id"].dataType.simpleString()).drop("record_id")
