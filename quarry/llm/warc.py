"""Content-addressed WARC archive with DataFrame functions (``import_files`` alone needs Python).

An archive is two tables in a shared folder: ``payloads`` (SHA-256, bytes), each payload once, and ``records``
(record id, exact record head, digest), one row per record; the head is the WARC header block and the HTTP header, byte
for byte. Reading joins the two by digest, after the payload's digest was computed again and held against its key, rebuilds each
record, and holds its length and digest against what its head says (a mismatch fails the job); the head's fields are parsed back.
``record_bytes`` gives whole records, ``export`` writes them as WARC files that any reader takes, ``import_files`` reads such files.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest page_id is the response, the others are revisits that refer
to it; smaller payloads are responses all.

Only ids, digests and lengths are shuffled to find the revisits; payload bytes once, reduced to one per digest in each task
before.

Defined results: a null payload is empty; a null page_id sorts after all others and is kept as such; of rows that repeat
page_id and payload the first in table order is the response; a null url is written as ``urn:page:`` and the id; line breaks in a url become
%0A and %0D; an empty table gives an empty archive; extra columns are not read.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 100
#: The date of records whose pages have none.
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def _urn(*columns: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_END))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> None:
    """Writes the records and payloads of ``pages`` below ``path``."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.monotonically_increasing_id().alias("row"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows.select(F.unhex("digest").alias("digest"), "payload").groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")

    index = common.save(rows.select("page_id", "url", "row", "digest", F.octet_length("payload").cast("long").alias("bytes")), "warc-index")
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("row"))
    first = index.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min(order).alias("first"), F.min_by("url", order).alias("first_url"))
    first = first.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"), "first_url")
    heads = index.join(first, "digest", "left").withColumn("revisit", F.coalesce(F.col("row") != F.col("first_row"), F.lit(False)))

    def uri(url: str, page: str) -> Column:
        url = F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
        return F.coalesce(url, F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("null"))))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    refers = F.when(
        F.col("revisit"),
        F.concat(_line("WARC-Profile", F.lit(_PROFILE)), _line("WARC-Refers-To", _urn(F.col("first_id"), F.col("first_row"))), _line("WARC-Refers-To-Target-URI", uri("first_url", "first_id"))),
    ).otherwise("")
    warc = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri("url", "page_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        refers,
        F.when(F.col("page_id").isNotNull(), _line("X-Page-Id", F.col("page_id").cast("string"))).otherwise(""),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(_END),
    )
    heads = heads.withColumn("record_id", _urn(F.col("page_id"), F.col("row"))).withColumn("http", http).withColumn("warc", warc)
    heads.select("record_id", F.concat("warc", "http").alias("head"), F.unhex("digest").alias("digest")).write.parquet(f"{path}/records")


def _field(name: str) -> Column:
    got = F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r\n]*)", 1)
    return F.when(got != "", got)


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive without payloads: record_id, head, digest, page_id, url, record_type, refers_to_record."""
    records = spark.read.schema("record_id string, head string, digest binary").parquet(f"{path}/records")
    return records.select(
        "record_id", "head", "digest",
        _field("X-Page-Id").cast("long").alias("page_id"), _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("record_type"), _field("WARC-Refers-To").alias("refers_to_record"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Whole records: those of read_heads with payload, payload_bytes and payload_digest."""
    stored = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    checked = F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.lower(F.hex("digest"))).otherwise(F.raise_error(F.lit("a stored payload doesn't have its digest")))
    stored = stored.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), checked.cast("string").alias("payload_digest"))
    out = read_heads(spark, path).join(stored, "digest").drop("digest")
    # the record as it is rebuilt: its head, then as many bytes as the head tells
    warc_head = F.octet_length(F.substring_index("head", _END * 2, 1)) + 4
    length = F.octet_length("head") - warc_head + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    fits = (length == _field("Content-Length").cast("long")) & (_field("WARC-Payload-Digest") == F.concat(F.lit("sha256:"), F.col("payload_digest")))
    url = F.when(F.coalesce(fits, F.lit(False)), F.col("url")).otherwise(F.raise_error(F.lit("a record doesn't fit its head: length or digest")))
    return out.withColumn("url", url.cast("string"))


def _body() -> Column:
    return F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))


def record_bytes(records: DataFrame) -> DataFrame:
    """(record_id, record): the whole records, as they would stand in a WARC file."""
    return records.select("record_id", F.concat(F.encode("head", "UTF-8"), _body(), F.lit(b"\r\n\r\n")).alias("record"))


def export(records: DataFrame, path: str) -> None:
    """Writes records as gzipped WARC files below ``path``, one a task, by Spark's own text sink: each record's bytes, then CR LF CR LF."""
    whole = F.concat(F.encode("head", "UTF-8"), _body()).cast("string")  # the cast keeps the bytes as they are
    records.select(whole.alias("value")).write.option("lineSep", _END * 2).option("compression", "gzip").text(path)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            data, heads, blocks, size = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw), [], [], 0
            while head := _head(data):
                found = re.search(rb"\r\nContent-Length: *(\d+)", head, re.I)
                block = data.read(int(found[1])) if found else b""
                if not found or len(block) < int(found[1]):
                    raise ValueError("a WARC record is cut off")
                heads.append(head.decode("utf-8", "replace"))
                blocks.append(block)
                size += len(block)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(blocks, pa.binary())], names=["head", "block"])
                    heads, blocks, size = [], [], 0
            if heads:
                yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(blocks, pa.binary())], names=["head", "block"])


def _head(data: BinaryIO) -> bytes:
    """The next record's header block with its empty line; nothing at the end."""
    lines = []
    while line := data.readline():
        if line == b"\r\n" and not lines:
            continue  # what ended the record before
        lines.append(line)
        if line == b"\r\n":
            break
    return b"".join(lines)


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, url, payload_digest, head, block) of each record of WARC files, gzipped or not; a file is read by one task, record by record."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    rows = files.mapInArrow(_parsed, "head string, block binary")
    return rows.select(_field("WARC-Record-ID").alias("record_id"), _field("WARC-Type").alias("record_type"), _field("WARC-Target-URI").alias("url"), _field("WARC-Payload-Digest").alias("payload_digest"), "head", "block")


def archive(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Writes an archive, reads it back, and returns page_id, payload_bytes, payload_digest, record_type, refers_to, url per record."""
    spark = pages.sparkSession
    path = path or f"{common.scratch_dir(spark)}/quarry-warc-{uuid.uuid4().hex}"
    write_archive(pages, path, **columns)
    records = read_archive(spark, path)
    responses = read_heads(spark, path).select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    out = records.join(responses, "refers_to_record", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
