"""WARC: revisit resolution and deduplicated archives.

Headers (id, digest, length) are shuffled by payload digest and give, of each digest that more than one record has, the record
that stays a response.  Payloads are shuffled only if their digest may be such a one; all others go straight into the
archives.  An archive file begins with a warcinfo record, every record is a gzip member of its own, and files end at a number
of bytes.  Files are written and committed by Spark's text sink, a file a value; the line end behind a value is an empty gzip
member.
"""

from __future__ import annotations

import hashlib
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import perhaps_among, scratch, stored, table, text_or_empty

#: Payloads of fewer bytes are always stored as responses.
LEAST_BYTES = 1000
#: A file ends at so many bytes (a longer record alone).
FILE_BYTES = 16_000_000
#: Parts that the records of one digest are dealt to.
SALTS = 16
END = "\r\n\r\n"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def repeated_digests(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """headers: id, digest, length.  digest, refers_to: of the records with one digest and ``least_bytes`` or more, the one with the
    largest id, for digests that more than one record has.  Null ids count as the smallest; null ids alone are left out."""
    big = headers.where(F.col("length") >= least_bytes)
    g = big.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")


def resolved(rows: DataFrame, first: DataFrame) -> DataFrame:
    """rows (id, digest, ...) with ``refers_to`` (null for responses); the records of a digest are dealt to SALTS parts."""
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    d = rows.withColumn("salt", salt).join(first.select("digest", "refers_to", every), ["digest", "salt"], "left").drop("salt")
    return d.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("refers_to")), F.col("refers_to")))


def record_id(column):
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(column.cast("string"), F.lit("null")), F.lit(">"))


def warc_records(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """head, body: each page's WARC record, its headers made anew, without the two line ends that close it.  A revisit has no payload.
    Null html is an empty payload."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), text_or_empty(html_col).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "length": F.octet_length("html").cast("long")})
    first = stored(repeated_digests(rows.select("id", "digest", "length"), least_bytes), "digests")
    may = perhaps_among(first, "digest")
    rows = rows.withColumn("_may", (F.col("length") >= least_bytes) & may("digest"))
    alone = rows.where(~F.col("_may")).withColumn("refers_to", F.lit(None).cast("long"))
    rows = alone.unionByName(resolved(rows.where("_may"), first))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("length"), F.lit(END))
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        record_id(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), record_id(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(http) + F.octet_length(body),
        F.lit(END),
        http,
    )
    return rows.select(head.alias("head"), body.alias("body"))


def member(*parts: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([*(c.compress(p) for p in parts), c.flush()])


def warcinfo(date: str) -> bytes:
    body = b"software: panelwright\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}{END}"
    return member(head.encode(), body, END.encode())


def write_archives(records: DataFrame, path: str, date: str, file_bytes: int = FILE_BYTES) -> None:
    """Records (head, body) as archive files of about ``file_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [warcinfo(date)], 0
        for batch in batches:
            for head, body in zip(batch.column(0), batch.column(1)):
                held.append(member(head.as_buffer(), body.as_buffer(), END.encode()))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [warcinfo(date)], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    files = records.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))  # the sink writes the bytes as they are
    files.write.option("lineSep", member().decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def _members(data: bytes) -> Iterator[bytes]:
    view = memoryview(data)
    while view:
        d = zlib.decompressobj(31)
        out = d.decompress(view) + d.flush()
        if not d.eof:
            raise ValueError("an archive ends inside a record")
        view = view[len(view) - len(d.unused_data) :]
        yield out


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a file."""
    for m in _members(data):
        if not m:
            continue
        end = m.index(b"\r\n\r\n")
        lines = m[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a member does not begin with a WARC record")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        if m[end + 4 + size :] != b"\r\n\r\n":
            raise ValueError(f"record {head['WARC-Record-ID']} is not closed after its length")
        yield head, m[end + 4 : end + 4 + size]


def _number(uri: str | None) -> int | None:
    inner = (uri or "<urn:x-page:null>")[12:-1]
    return None if inner == "null" else int(inner)


def parse_archives(payloads: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in _records(content.as_buffer()):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http, body = block.split(b"\r\n\r\n", 1)
                    digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
                    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    if not revisit and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"record {head['WARC-Record-ID']}: payload and headers differ")
                    rows.append((_number(head["WARC-Record-ID"]), length, digest, head["WARC-Type"], _number(head["WARC-Refers-To"]) if revisit else None, body.decode() if payloads and not revisit else None))
                    held += len(body)
                    if len(rows) >= 2000 or held > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return parse


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives in ``path``; responses are checked against their digests.
    ``payload`` is filled for responses if asked for."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")
    return files.mapInArrow(parse_archives(payloads), READ_SCHEMA)


def archive(pages: DataFrame, path: str, date: str | None = None, file_bytes: int = FILE_BYTES, **columns) -> None:
    """Write deduplicated archives of the pages.  ``date``: the records' WARC-Date, by default the time of the call.

    Null html is an empty payload; a null page_id counts as the smallest; repeated rows give a record each, and those that repeat
    the response's page_id are responses; very long pages are records of their own length; an empty table gives no record; other
    columns are ignored."""
    date = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    write_archives(warc_records(pages, date, **columns), path, date, file_bytes)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("payload")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, sha1(html) AS payload_digest, CAST(strlen(html) AS BIGINT) AS payload_bytes FROM p),
m AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN m.top IS NOT NULL AND d.page_id IS DISTINCT FROM m.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.top IS NOT NULL AND d.page_id IS DISTINCT FROM m.top THEN m.top END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 1000
"""
