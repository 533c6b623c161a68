"""A content-addressed archive of WARC records.

Payload bytes are stored once under their SHA-256, exact record headers apart from
them; the original records come back through a join of the two tables. A payload
read back is hashed again and a record whose bytes don't match is marked.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import stored, workspace

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    """``headers``: record_no, page_id, payload_key, header. ``payloads``: payload_key, payload."""

    headers: DataFrame
    payloads: DataFrame


@F.arrow_udf(T.BinaryType())
def _packed(payloads: pa.Array) -> pa.Array:
    """Payloads deflated, for the way through a shuffle."""
    return pa.array([None if x is None else zlib.compress(x, 4) for x in payloads.to_pylist()], pa.binary())


@F.arrow_udf(T.BinaryType())
def _unpacked(payloads: pa.Array) -> pa.Array:
    return pa.array([None if x is None else zlib.decompress(x) for x in payloads.to_pylist()], pa.binary())


def _payload(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def _record_id(page: Column, key: Column) -> Column:
    """A stable urn:uuid from what identifies the record."""
    h = F.sha2(F.concat_ws("|", page.cast("string"), key), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-4"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def _header(kind: Column, page_id: Column, refers: Column) -> Column:
    """WARC and HTTP header blocks of a record, as text without the payload.

    A line break in a url would end its header line; it is percent-encoded.
    """
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "\r", "%0D")
    url = F.regexp_replace(url, "\n", "%0A")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "),
        F.col("bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    block = F.octet_length(http) + F.when(kind == "response", F.col("bytes")).otherwise(0)
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    more = F.when(
        kind == "revisit",
        F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", _record_id(refers, F.col("payload_key"))),
                 line("X-Refers-To-Page", refers.cast("string"))),
    ).otherwise("")
    return F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", kind), line("WARC-Record-ID", _record_id(page_id, F.col("payload_key"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")), line("WARC-Target-URI", url),
        F.when(page_id.isNotNull(), line("X-Page-ID", page_id.cast("string"))).otherwise(""), more,
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")), F.lit(CRLF), http,
    )


def write_archive(pages: DataFrame, folder: str, least: int = 1000) -> Archive:
    """Write one record per row of ``page_id, url, html`` and return the written tables.

    Of records with equal payloads of at least ``least`` bytes the one with the largest
    page_id is the response, the others revisit it; smaller ones are all responses.
    Null html is an empty payload. Rows that repeat a page_id give a record each; those
    with the response's page_id are responses too. Rows without a page_id give records
    without one, which are never revisited unless all equal ones lack it.
    """
    payload = _payload(F.col("html"))
    slim = stored(
        pages.select(
            "page_id", "url", F.sha2(payload, 256).alias("payload_key"), F.sha1(payload).alias("sha1"),
            F.octet_length(payload).cast("long").alias("bytes"),
        ),
        "records",
    )
    counted = slim.groupBy("payload_key", "page_id").agg(F.count("*").alias("rows"))
    top = F.max(F.struct("page_id", "rows")).alias("_top")
    best = counted.groupBy("payload_key").agg(top).select("payload_key", F.col("_top.page_id").alias("holder"), F.col("_top.rows").alias("rows"))
    best = stored(best, "holders")
    beside = slim.join(best, "payload_key")
    small = F.col("bytes") < least
    kind = F.when(small | F.col("page_id").eqNullSafe(F.col("holder")), "response").otherwise("revisit")
    headers = beside.withColumn("_kind", kind).select(
        "page_id", "payload_key", _header(F.col("_kind"), F.col("page_id"), F.col("holder")).alias("header")
    )
    headers.write.option("compression", "zstd").parquet(f"{folder}/headers")
    keyed = pages.select("page_id", F.sha2(payload, 256).alias("payload_key"), _packed(payload).alias("packed"))

    def held(holders: DataFrame) -> DataFrame:
        """The bytes come from the holder's row, so no copy of them moves with a frequent key."""
        named = holders.select(F.col("holder").alias("_id"), F.col("payload_key").alias("_key"))
        on = (F.col("payload_key") == F.col("_key")) & F.col("page_id").eqNullSafe(F.col("_id"))
        return keyed.join(named, on, "left_semi").select("payload_key", "packed")

    kept = held(best.where("rows = 1"))
    if not (several := best.where("rows > 1")).isEmpty():  # rows that repeat a page_id and its html
        kept = kept.unionByName(held(several).dropDuplicates(["payload_key"]))
    kept = kept.select("payload_key", _unpacked(F.col("packed")).alias("payload"))
    kept.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    return read_archive(pages.sparkSession, folder)


def read_archive(spark, folder: str) -> Archive:
    headers = "page_id long, payload_key string, header string"
    return Archive(
        spark.read.schema(headers).parquet(f"{folder}/headers"),
        spark.read.schema("payload_key string, payload binary").parquet(f"{folder}/payloads"),
    )


def records(archive: Archive) -> DataFrame:
    """``page_id, header, payload, intact``: every record with its full payload.

    For a revisit the payload is that of the record it refers to. ``intact`` says
    that the bytes read back have the key they are stored under.
    """
    packed = archive.payloads.select("payload_key", _packed(F.col("payload")).alias("_packed"))
    joined = archive.headers.join(packed, "payload_key", "left").withColumn("payload", _unpacked(F.col("_packed")))
    intact = F.coalesce(F.sha2("payload", 256) == F.col("payload_key"), F.lit(False))
    return joined.select("page_id", "header", "payload", intact.alias("intact"))


def _field(name: str) -> Column:
    """A header field; it stands before the HTTP block, so the first match is the record's own."""
    return F.regexp_extract("header", f"\r\n{name}: ([^\r]*)\r\n", 1)


def _record() -> Column:
    """The bytes of a record from its header and payload; NULL if it is a response whose payload is lost."""
    full = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.encode("header", "UTF-8"), full, F.lit(b"\r\n\r\n"))


def record_bytes(archive: Archive) -> DataFrame:
    """``page_id, record``: the exact bytes of every record as a WARC file holds them."""
    return records(archive).select("page_id", _record().alias("record"))


def report(archive: Archive) -> DataFrame:
    """Per record, rebuilt: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url, verified``.

    A response's payload is cut out of its rebuilt bytes, a revisit's is that of the
    record it refers to. ``verified`` says that the payload has the key it is stored
    under and the digest its header names, and that the rebuilt block is as long as
    the record's Content-Length.
    """
    rebuilt = records(archive).withColumn("record", _record())
    # The record's own header ends at the first empty line, its payload starts after the HTTP header.
    head = F.octet_length(F.substring_index("header", CRLF + CRLF, 1)) + 4
    block = F.octet_length("record") - head - 4
    cut = F.substring(F.col("record"), F.octet_length("header") + 1, F.octet_length("record") - F.octet_length("header") - 4)
    told = rebuilt.withColumn("_type", _field("WARC-Type")).withColumn("_fits", block == _field("Content-Length").cast("long"))
    told = told.withColumn("_body", F.when(F.col("_type") == "response", cut).otherwise(F.col("payload")))
    told = told.withColumn("payload_digest", F.sha1("_body"))
    refers = _field("X-Refers-To-Page")
    same = F.concat(F.lit("sha1:"), F.col("payload_digest")) == _field("WARC-Payload-Digest")
    return told.select(
        "page_id", F.octet_length("_body").cast("long").alias("payload_bytes"), "payload_digest", F.col("_type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"), _field("WARC-Target-URI").alias("url"),
        F.coalesce(F.col("intact") & same & F.col("_fits"), F.lit(False)).alias("verified"),
    )


def archive_report(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and report its records read back."""
    return report(write_archive(pages, workspace(pages.sparkSession, "warc"), least))
