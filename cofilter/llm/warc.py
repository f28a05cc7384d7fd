"""WARC archives: write captures, read them back, assemble transactions.

Each page gives three records: a request, a response (or a revisit of an earlier
response with the same payload) and metadata; request and metadata name the
response's record id in WARC-Concurrent-To. Records are text, so Spark's text
writer stores them on any file system, gzipped, the record end as its line separator.
Reading parses the files by Content-Length, keeps the three record types apart,
and joins them through the concurrent-to ids into one nested row per capture;
revisits find their payload's digest and length through WARC-Refers-To.

Payloads are the UTF-8 bytes of the html, null counts as empty. Equal payloads of
``MIN_SHARED`` bytes or more are stored once, with the largest page id. A null url
is written as an empty target. Pages with a null id are left out; rows that
repeat a page id are one capture (the largest html, then url). Extra columns are
ignored. Files hold about ``FILE_BYTES``; a longer payload has a file of its own."""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofilter.llm.common import mapped, stored
from cofilter.session import scratch_path

MIN_SHARED = 1000
FILE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _id(kind: str, page: str = "page_id"):
    """Record ids follow from the page id: its 64 bits end a UUID, the kind begins it."""
    number = F.lower(F.lpad(F.hex(page), 16, "0"))
    return F.concat(F.lit(f"<urn:uuid:{kind}-0000-4000-"), F.substring(number, 1, 4), F.lit("-"),
                    F.substring(number, 5, 12), F.lit(">"))


REQUEST, RESPONSE, METADATA = "00000001", "00000002", "00000003"


def _record(kind, record_id, headers: list, block):
    lines = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
             F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), F.col("url")), *headers,
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit(END), block)


def _shape(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.translate(F.coalesce("url", F.lit("")), "\r\n", "").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html")).where("page_id IS NOT NULL")


def decisions(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """(page_id, bytes, digest, url, n, refers_to) of each capture, without payloads: n
    rows share the page id; refers_to is the page that holds an equal payload."""
    light = _shape(pages).select("page_id", F.octet_length("html").alias("bytes"), F.sha1("html").alias("digest"), "url")
    best = light.groupBy("page_id").agg(F.max(F.struct("bytes", "digest", "url")).alias("m"),
                                        F.count(F.lit(1)).alias("n")).select("page_id", "m.*", "n")
    best = stored(best, "captures")
    holder = (best.where(F.col("bytes") >= min_shared).groupBy("digest", "bytes")
              .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    held = best.join(holder, ["digest", "bytes"], "left")
    return held.withColumn("refers_to", F.when(F.col("holder") != F.col("page_id"), F.col("holder"))).drop("holder")


def captures(pages: DataFrame, files: int, min_shared: int = MIN_SHARED) -> DataFrame:
    """The captures with their payloads, dealt into ``files`` partitions: the only
    time payloads are shuffled."""
    found = stored(decisions(pages, min_shared), "decisions")
    rows = _shape(pages).repartition(files, "page_id")
    held = rows.join(found.drop("url").where("n = 1").repartition(files, "page_id"), "page_id").drop("n")
    if found.where("n > 1").isEmpty():
        return held
    # rows that share a page id: one that equals the capture
    again = rows.join(found.where("n > 1").withColumnRenamed("url", "u"), "page_id").where(
        "url = u AND octet_length(html) = bytes AND sha1(html) = digest").drop("u", "n")
    return held.unionByName(again.dropDuplicates(["page_id"]))


def records(held: DataFrame) -> DataFrame:
    """(record): three WARC records for each capture."""
    response = _id(RESPONSE)
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), response)
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    whole = _record(F.lit("response"), response, [F.lit("Content-Type: application/http; msgtype=response"), digest],
                    F.concat(http, F.col("html")))
    again = _record(F.lit("revisit"), response, [
        F.lit("Content-Type: application/http; msgtype=response"), digest, F.lit(f"WARC-Profile: {PROFILE}"),
        F.concat(F.lit("WARC-Refers-To: "), _id(RESPONSE, "refers_to"))], http)
    asked = _record(F.lit("request"), _id(REQUEST), [
        F.lit("Content-Type: application/http; msgtype=request"), concurrent],
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + END)))
    about = _record(F.lit("metadata"), _id(METADATA), [F.lit("Content-Type: application/warc-fields"), concurrent],
                    F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")))
    return held.select(F.explode(F.array(
        asked, F.when(F.col("refers_to").isNull(), whole).otherwise(again), about)).alias("record"))


def write(pages: DataFrame, path: str, min_shared: int = MIN_SHARED, file_bytes: int = FILE_BYTES) -> None:
    """Write the archives of all pages under ``path``, records of about ``file_bytes`` in each file."""
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    held = captures(pages, max(1, int(total // file_bytes) + 1), min_shared)
    records(held).write.option("lineSep", END).option("compression", "gzip").text(path)


def parse(raw: bytes, with_payload: bool):
    """The records of one unpacked archive: (type, id, concurrent-to, refers-to, url, digest, payload length, page id, payload)."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        lines = raw[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        size = int(head["content-length"])
        begin, end = stop + 4, stop + 4 + size
        kind = head["warc-type"]
        length = payload = page = digest = None
        if kind in ("response", "revisit"):
            body = raw.index(b"\r\n\r\n", begin) + 4
            digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind == "response":
                payload = raw[body:end]
                length = len(payload)
                digest = hashlib.sha1(payload).hexdigest()  # noqa: S324 - the format's digest
                payload = payload if with_payload else None
        elif kind == "metadata":
            page = int(raw[begin:end].decode().partition("page-id: ")[2].partition("\r\n")[0])
        yield (kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"),
               head.get("warc-target-uri", ""), digest, length, page, payload)
        at = end + 4


FIELDS = ["type", "id", "concurrent_to", "refers_to", "url", "digest", "length", "page_id", "payload"]
SCHEMA = ("type string, id string, concurrent_to string, refers_to string, url string, digest string, "
          "length long, page_id long, payload binary")
_TYPES = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.binary()]


def read_records(spark, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives under ``path``, one row each."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for r in parse(gzip.decompress(content.as_buffer()), with_payload):
                    rows.append(r)
                    held += len(r[8] or b"")
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return mapped(files, run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], names=FIELDS)


def transactions(found: DataFrame) -> DataFrame:
    """One row per capture: page_id, url, request, response and metadata (each a
    struct), and the payload's length and digest, for revisits those of the response
    they refer to."""
    answer = found.where(F.col("type").isin("response", "revisit")).select(
        F.col("id").alias("key"), F.struct("type", "id", "refers_to", "url", "digest", "length", "payload").alias("response"))
    request = found.where("type = 'request'").select(
        F.col("concurrent_to").alias("key"), F.struct("id", "url").alias("request"))
    about = found.where("type = 'metadata'").select(
        F.col("concurrent_to").alias("key"), F.struct("id", "page_id").alias("metadata"))
    whole = answer.join(about, "key").join(request, "key")
    origin = found.where("type = 'response'").join(
        found.where("type = 'metadata'").select(F.col("concurrent_to").alias("id"), F.col("page_id").alias("p")), "id")
    origin = origin.select(F.col("id").alias("of"), F.col("length").alias("of_length"), F.col("p").alias("of_page"))
    return (whole.withColumn("of", F.col("response.refers_to")).join(origin, "of", "left")
            .select(F.col("metadata.page_id").alias("page_id"), F.col("response.url").alias("url"), "request", "response",
                    "metadata", F.coalesce("response.length", "of_length").alias("payload_bytes"),
                    F.col("response.digest").alias("payload_digest"), F.col("of_page").alias("refers_to")))


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write the archives into the shared scratch folder, read them back, assemble."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    return transactions(stored(read_records(pages.sparkSession, path, with_payload), "records"))
