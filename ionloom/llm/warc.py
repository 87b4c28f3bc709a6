"""WARC archives without repeated payloads.

Revisit resolution: headers (id and digest, no payload) are shuffled by payload digest, pre-aggregated; of equal
payloads the page with the smallest id is archived as a response and every other one as a revisit record that
refers to it. Archives are plain WARC/1.1 in gzip, written by Spark's own writer to any file system it knows, cut by
the bytes of their records. Reading them back parses every record by its length, checks each payload
against its digest and joins revisits to the responses they refer to.

Defined results: a null or empty page is a response with an empty payload. Payloads below ``least`` bytes are always
responses. Rows that share a page id and a payload get records of the same kind. A null page id is a response only
if no other page has the payload. Line ends in a URL become spaces; a null URL is left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.common import narrow_batches

CRLF = "\r\n"
FILE_BYTES = 64 << 20  # a file's records add up to about this at most, unless a single record is longer
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: str, digest: str) -> Column:
    """A URN made from the page id and the digest, so that a repeated task writes the same record."""
    code = F.md5(F.concat_ws("/", F.lit("page"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.col(digest)))
    parts = [F.substring(code, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def resolve(pages: DataFrame, least: int = 100) -> DataFrame:
    """Per distinct page id and digest: digest, bytes and the page that holds the response (null: itself)."""
    heads = pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    first = heads.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("digest", "first")
    resolved = heads.dropDuplicates(["page_id", "digest"]).join(first, "digest", "left")
    original = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return resolved.select("page_id", "digest", "bytes", original.alias("original"))


def records(pages: DataFrame, resolved: DataFrame, date: str) -> DataFrame:
    """One string per page: the whole record but for the two line ends after it."""
    own = resolved.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "bytes", "original")
    joined = pages.join(own, F.col("page_id").eqNullSafe(F.col("__page")) & (F.sha2("payload", 256) == F.col("__digest")))
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    lines = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", record_id("page_id", "__digest")),
        F.lit(f"WARC-Date: {date}"),
        field("WARC-Target-URI", F.translate("url", CRLF, "  ")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("__digest"))),
        F.when(revisit, field("WARC-Refers-To", record_id("original", "__digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        field("X-Page-Id", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", F.octet_length(block).cast("string")),
    )
    return joined.select(F.concat(lines, F.lit(CRLF * 2), block).alias("value"))


def filled(rows: DataFrame, most: int) -> DataFrame:
    """Records joined, in the order they come, to strings of about ``most`` bytes at most, or of one longer record."""
    end = (CRLF * 2).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary()).cast(pa.string())], names=["value"])

        for part in batches:
            for record in part.column(0).cast(pa.binary()).to_pylist():
                if held and size + len(record) > most:
                    yield batch()
                    held, size = [], 0
                held.append(record)
                size += len(record) + len(end)
        if held:
            yield batch()

    return rows.mapInArrow(run, "value string")


def write_archives(pages: DataFrame, folder: str, least: int = 100, date: str = "2024-01-01T00:00:00Z", page: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archive every page below ``folder``."""
    pages = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    narrow_batches(pages.sparkSession)
    rows = filled(records(pages, resolve(pages, least), date), FILE_BYTES)
    rows.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 1).text(folder)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of every record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, content[start:stop]
        at = stop + 4


def _page_record(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't hold its payload")
    page = fields.get("X-Page-Id")
    return fields["WARC-Record-ID"], None if page is None else int(page), size, digest, fields["WARC-Type"], fields.get("WARC-Refers-To"), fields.get("WARC-Target-URI"), payload


def unpacked(content: bytes) -> bytes:
    """All members of a gzip file, one after the other; zeros after the last are padding."""
    parts, at, view, padding = [], 0, memoryview(content), len(content.rstrip(b"\0"))
    while at < padding:
        member = zlib.decompressobj(wbits=31)
        # in steps, so that what follows a member is not copied once for each
        while not member.eof:
            if at >= len(content):
                raise ValueError("the archive is cut short")
            parts.append(member.decompress(view[at : at + STEP]))
            at = min(at + STEP, len(content)) - len(member.unused_data)
    return b"".join(parts)


STEP = 1 << 14  # bytes of an archive that are unpacked at once

COLUMNS = ["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to_record", "url", "payload"]


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """One row per record: ids, size, digest, kind, the record referred to, the URL and, if wanted, the payload."""
    narrow_batches(spark, 1)
    names = COLUMNS if payload else COLUMNS[:-1]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [_page_record(*r)[: len(names)] for r in parse(unpacked(content.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_record string, url string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("content").mapInArrow(run, schema + (", payload binary" if payload else ""))


def resolved_records(found: DataFrame) -> DataFrame:
    """Records with ``refers_to``, the page id of the response that a revisit refers to."""
    responses = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")).distinct()
    return found.join(responses, "refers_to_record", "left")
