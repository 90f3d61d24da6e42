"""WARC archives with revisit resolution: headers are shuffled by payload digest, never payload by payload compared.

The least record of a digest is its original response; the others become revisit records that refer to it and
carry no payload. Archives are written by Spark's own file writer (records end with CRLF CRLF, which is the
separator it puts after each), so they land in the shared folder through whatever file system the path names, and
a lost task is simply written again. Each file is one gzip stream of at most ``per_file`` records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import column, new_path, small_batches

END = "\r\n"
SCHEMA = "record_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of a text's SHA-1: each 5 bytes are 8 digits of radix 32, renamed."""
    hexed = F.sha1(F.encode(text, "UTF-8"))
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """``record_id, url, payload, payload_bytes, payload_digest``; a null payload is an empty one."""
    p = pages.select(column(id_col).cast("long").alias("record_id"), column(url_col).cast("string").alias("url"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("payload"))
    return p.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def resolve(recs: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``record_type`` and ``refers_to`` by joining each record with the least record of its digest.

    Only payloads of at least ``min_bytes`` are resolved; smaller ones are all responses. The least ids are found by
    an aggregation that combines on the map side, so a digest shared by a third of all records is one row per task;
    the join on digest is one that adaptive execution splits. A record whose id equals the least one (also when
    rows are repeated, or ids are null) is a response.
    """
    least = recs.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("record_id").alias("original"))
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("original").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("original"))
    return recs.join(least, "payload_digest", "left").select(
        "record_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to")
    )


def as_text(resolved: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: each record with fresh headers, without the blank lines that end it."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(END))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("record_id")),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(END + END),
    )
    return resolved.withColumn("block", block).select(F.concat(head, "block").alias("value"))


def write(resolved: DataFrame, path: str, per_file: int = 4000) -> None:
    as_text(resolved).write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _lines(stream: io.BufferedReader) -> Iterator[str]:
    while (line := stream.readline()) not in (b"\r\n", b""):
        yield line.decode().rstrip("\r\n")


class _Inflated(io.RawIOBase):
    """The bytes of a gzip file held in memory, inflated a piece at a time; further members follow on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.left, self.z = memoryview(data), 0, b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.left:
            if self.z.eof:
                rest = len(self.z.unused_data)
                self.at, self.z = self.at - rest, zlib.decompressobj(31)
            tail = self.z.unconsumed_tail
            if not tail:
                tail, self.at = self.data[self.at : self.at + 65536], min(self.at + 65536, len(self.data))
                if not len(tail):
                    return 0
            self.left = self.z.decompress(tail, 1 << 18)
        n = min(len(out), len(self.left))
        out[:n], self.left = self.left[:n], self.left[n:]
        return n


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one gzipped archive; the payload of each response is checked against its digest."""
    stream = io.BufferedReader(_Inflated(data), 1 << 18)
    number = lambda urn: None if urn in (None, "<urn:record:none>") else int(urn.rstrip(">").rpartition(":")[2])
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            if first.strip():
                raise ValueError(f"no WARC record begins with {first[:40]!r}")
            continue
        head = dict(x.split(": ", 1) for x in _lines(stream))
        block = stream.read(int(head["Content-Length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{head['WARC-Record-ID']}: the payload is not the one of its digest")
        yield number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, number(head.get("WARC-Refers-To")), size, digest, payload if kind == "response" else None


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``, columns as in SCHEMA; ``payloads=False`` leaves payload null."""
    small_batches(spark, 512)
    schema = pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in (x for b in batches for x in b.column(0)):
            rows, size = [], 0
            for r in parse(data.as_buffer()):
                rows.append(r if payloads else (*r[:6], None))
                size += len(r[6] or b"") * payloads + 200
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, SCHEMA)


def archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Write deduplicated archives of all pages, then read them back: the records as :func:`read` gives them.

    Null or empty pages are records with an empty payload; repeated rows are records each; an empty table gives no
    archive records; blanks and controls in a URL are written as %20, a null URL is left out; other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(resolve(records(pages, id_col, url_col, text_col), min_bytes), path)
    return read(spark, path, payloads=False)
