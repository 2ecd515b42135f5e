"""WARC archives with revisit records.

1. ``write_archives``: a response record per page, written by Spark's text sink, gzip-compressed.
2. ``read_records``: archives read as whole files and cut by their Content-Length; each
   file holds at most ``RECORDS_PER_FILE`` records, so a task's memory is bounded by one file.
3. ``resolve``: headers (no payloads) are aggregated by payload digest; of equal payloads of at
   least ``MIN_BYTES`` bytes the smallest page id is the original response, others
   revisit it.  Revisit records already in an archive point to their digest's original.
4. ``write_archives`` again with fresh headers: revisits keep the HTTP headers and drop the payload.

The digest group of a third of all rows is one row after the partial aggregation; the join back
to the headers has a splittable side.  Payloads never pass through the digest shuffle.

Edge cases: null html is an empty payload; null urls get the URI ``urn:page:<id>``; CR, LF and
spaces in urls are percent-encoded; rows that repeat the original's page id and payload are
responses like it; a null page id comes after all others (a group of null ids only has responses);
payloads may contain any text, WARC headers too, since records are cut by length; an empty table gives
empty archives; extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 100
RECORDS_PER_FILE = 1024
WARC_DATE = "1970-01-01T00:00:00Z"  # the tables carry no fetch time
RECORD = ("page_id bigint, record_type string, target_uri string, refers_to bigint, payload_digest string, "
          "payload_bytes bigint, payload string")


def _record_uri(page_id):
    """A stable record id: a name-based UUID of the page id."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def _line(name: str, value):
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise("")


def record_text(page_id, record_type, uri, refers_to, digest, payload_bytes, payload):
    """One WARC record without its last line feed (the text sink writes that)."""
    is_revisit = record_type == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.coalesce(payload_bytes, F.lit(0)).cast("string"), F.lit("\r\n\r\n"))
    block = F.when(is_revisit, http).otherwise(F.concat(http, payload))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), record_type, F.lit("\r\n"),
        F.lit("WARC-Record-ID: "), _record_uri(page_id), F.lit(f"\r\nWARC-Date: {WARC_DATE}\r\n"),
        _line("WARC-Target-URI", uri),
        _line("X-Page-ID", page_id.cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _line("X-Payload-Length", payload_bytes.cast("string")),
        F.when(is_revisit, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
            F.when(refers_to.isNotNull(), F.concat(F.lit("WARC-Refers-To: "), _record_uri(refers_to), F.lit("\r\n"))).otherwise(""),
            _line("X-Refers-To-Page", refers_to.cast("string")))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(is_revisit, F.lit(0)).otherwise(payload_bytes)).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as response records (``RECORD`` columns)."""
    payload = F.coalesce(pages[html_col], F.lit(""))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace(pages[url_col], "\r", "%0D"), "\n", "%0A"), " ", "%20")
    return pages.select(
        pages[id_col].cast("long").alias("page_id"), F.lit("response").alias("record_type"),
        F.coalesce(uri, F.concat(F.lit("urn:page:"), F.coalesce(pages[id_col].cast("string"), F.lit("null")))).alias("target_uri"),
        F.lit(None).cast("long").alias("refers_to"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), payload.alias("payload"))


def write_archives(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    c = records
    text = record_text(c["page_id"], c["record_type"], c["target_uri"], c["refers_to"], c["payload_digest"],
                       c["payload_bytes"], c["payload"])
    (c.select(text.alias("value")).write.option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse_archive(data: bytes, with_payload: bool = True) -> Iterator[tuple]:
    """Response and revisit records of one archive file as ``RECORD`` tuples, cut by Content-Length.

    Digest and length of a response come from its payload's bytes, whatever its headers say; those of a revisit,
    which has no payload, from its headers (null where it names none, or another kind of digest).  Records of other types, and a response
    without an HTTP message, are passed over.  A payload that is not UTF-8 is an error where payloads are read.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:head_end].decode(errors="replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name] = value.strip(" \t")
        block = head_end + 4
        end = block + int(head["Content-Length"])
        at = end + 4
        kind, body = head.get("WARC-Type"), data.find(b"\r\n\r\n", block, end) + 4
        payload, digest, length = None, head.get("WARC-Payload-Digest"), head.get("X-Payload-Length")
        if kind == "response" and body > 3:
            content = data[body:end]
            digest, length = hashlib.sha256(content).hexdigest(), len(content)
            payload = content.decode() if with_payload else None
        elif kind == "revisit":
            digest = digest[7:] if digest and digest.startswith("sha256:") else None
            length = None if length is None else int(length)
        else:
            continue
        page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
        yield (None if page is None else int(page), kind, head.get("WARC-Target-URI"),
               None if refers is None else int(refers), digest, length, payload)


def read_records(spark: SparkSession, path: str, with_payload: bool = True, rows_per_batch: int = 256) -> DataFrame:
    """Records of all archives below ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()),
                        ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                for r in parse_archive(content.as_py(), with_payload):
                    rows.append(r)
                    if len(rows) >= rows_per_batch:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return files.mapInArrow(run, RECORD)


def resolve(records: DataFrame, heads: DataFrame | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Records with ``record_type`` and ``refers_to`` set anew by payload digest.

    ``heads`` are the same records read without payloads.  Only they are shuffled by digest;
    the pages to change then join the records by page.
    """
    heads = (records if heads is None else heads).select("page_id", "record_type", "payload_digest", "payload_bytes")
    heads = heads.where(F.col("payload_bytes") >= min_bytes)
    firsts = heads.where("record_type = 'response'").groupBy("payload_digest").agg(
        F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("times"))
    firsts = firsts.where("first_page IS NOT NULL").select(F.col("payload_digest").alias("fd"), "first_page")
    change = heads.join(firsts, F.col("payload_digest") == F.col("fd")).where(
        ~F.col("page_id").eqNullSafe(F.col("first_page"))).select(
        F.col("page_id").alias("cp"), F.col("payload_digest").alias("cd"), "first_page").distinct()
    joined = records.join(change, F.col("page_id").eqNullSafe(F.col("cp")) & (F.col("payload_digest") == F.col("cd")), "left")
    again = F.col("first_page").isNotNull()
    # a revisit record without an original in these archives keeps what it says
    orphan = F.col("record_type") == "revisit"
    return joined.select(
        "page_id", F.when(orphan | again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(again, F.col("first_page")).when(orphan, F.col("refers_to")).alias("refers_to"),
        "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"))


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES) -> None:
    """Read archives, resolve revisits, write deduplicated archives with fresh headers."""
    records, heads = read_records(spark, source), read_records(spark, source, with_payload=False)
    write_archives(resolve(records, heads, min_bytes), target)
