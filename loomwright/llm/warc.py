"""WARC archives (8) as a chunked record table.

An archive is a table of (archive, record, chunk) rows.  A record's bytes in WARC/1.1
form are cut into chunks of a bounded size, so an oversized payload is streamed and
never one allocation; each chunk row carries the SHA-1 of the payload up to its end
(``prefix_sha1``), so a reader checks what it has so far after each chunk.  Joining
``data`` in the order (record, chunk) gives the bytes of an ordinary .warc file.

Equal payloads of at least ``least`` bytes are stored once: the row with the largest
page_id is the response, the others are revisits that refer to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, shared_dir, small_batches

CHUNK = 1 << 20
SALTS = 16
_TABLE = "archive int, record long, chunk int, last boolean, data binary, prefix_sha1 string"


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload.  A null page_id is smaller than any other.  Rows
    that repeat both page_id and payload are all responses if theirs is the largest id.
    The join is salted, so a payload that a third of all pages share is dealt out.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.encode(html, "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    lone = html.isNotNull() & (F.octet_length(html) >= least)
    shared = (
        pages.where(lone)
        .groupBy(F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"))
        .agg(F.max(F.col("page_id").cast("long")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("payload_digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    )
    rows = rows.join(shared, ["payload_digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("payload_bytes") >= least)
    return rows.select(
        "page_id", "url", F.when(revisit, None).otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _header(page_id, url, size, digest, kind, refers) -> tuple[bytes, int]:
    """The WARC header with the block's HTTP header, and the block's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    length = len(http) + (size if kind == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + http, length


def write_archive(records: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Write planned records as the chunk table; one archive a partition."""
    schema = pa.schema([("archive", pa.int32()), ("record", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("prefix_sha1", pa.string())])

    def cut(batches):
        for batch in batches:
            rows, held = [], 0
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                archive, record, page_id, url, size, digest, kind, refers = (c[i].as_py() for c in (*cols[:4], *cols[5:9]))
                head, _ = _header(page_id, url, size, digest, kind, refers)
                body = memoryview(cols[4][i].as_buffer() or b"") if kind == "response" else memoryview(b"")
                sha, at, k = hashlib.sha1(), 0, 0
                while True:
                    room = max(1, chunk - (len(head) if k == 0 else 0))
                    part = body[at : at + room]
                    sha.update(part)
                    at += len(part)
                    last = at >= len(body)
                    data = (head if k == 0 else b"") + bytes(part) + (b"\r\n\r\n" if last else b"")
                    rows.append((archive, record, k, last, data, sha.copy().hexdigest()))
                    held += len(data)
                    if held > 4 << 20:  # what is held is bounded, however long the record
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                    if last:
                        break
                    k += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    cols = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = records.select(F.spark_partition_id().alias("archive"), F.monotonically_increasing_id().alias("record"), *cols)
    rows.mapInArrow(released(cut), _TABLE).write.option("compression", "zstd").parquet(path)


class CorruptArchive(ValueError):
    """A chunk's digest, a length or the order of chunks is wrong."""


class RecordReader:
    """Feeds on the chunks of one record in order, holding no more than its header."""

    def __init__(self) -> None:
        self.head, self.next, self.sha, self.size, self.fields = b"", 0, hashlib.sha1(), 0, None

    def feed(self, number: int, last: bool, data: bytes, prefix: str) -> tuple | None:
        """The finished record's row, after its last chunk."""
        if number != self.next:
            raise CorruptArchive(f"chunk {number} follows {self.next - 1}")
        self.next += 1
        if self.fields is None:
            data = self.head + data
            ends = re.match(rb"(?s)(WARC/1\.1\r\n.*?\r\n\r\n)(HTTP/.*?\r\n\r\n)", data)
            if not ends:
                self.head = data
                if last:
                    raise CorruptArchive("no header")
                return None
            self.fields = dict(line.split(": ", 1) for line in ends[1].decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
            self.http, data = ends[2], data[ends.end() :]
        if last:
            if not data.endswith(b"\r\n\r\n"):
                raise CorruptArchive("no end of record")
            data = data[:-4]
        self.sha.update(data)
        self.size += len(data)
        if self.sha.copy().hexdigest() != prefix:
            raise CorruptArchive(f"chunk {number} isn't what was written")
        if not last:
            return None
        kind, digest = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if int(self.fields["Content-Length"]) != len(self.http) + self.size:
            raise CorruptArchive("a length is wrong")
        full = int(re.search(rb"Content-Length: (\d+)", self.http)[1])
        if kind == "response" and (self.sha.hexdigest() != digest or full != self.size):
            raise CorruptArchive("the payload isn't what was written")
        number_of = lambda urn: int(urn[10:-1]) if urn and urn[10:-1] else None
        return number_of(self.fields["WARC-Record-ID"]), self.fields.get("WARC-Target-URI"), full, digest, kind, number_of(self.fields.get("WARC-Refers-To"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to from the chunk table.

    Records of one chunk are read where they lie; only records of several chunks are
    brought together by record, and their chunks stream through a digest.
    """

    def parse(batches) -> Iterator[pa.RecordBatch]:
        reader, own = None, None
        for batch in batches:
            rows = []
            for archive, record, number, last, data, prefix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != (archive, record):
                    if reader:
                        raise CorruptArchive(f"record {own} has no last chunk")
                    reader, own = RecordReader(), (archive, record)
                row = reader.feed(number, last, data, prefix)
                if row:
                    rows.append(row)
                    reader, own = None, None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if reader:
            raise CorruptArchive(f"record {own} has no last chunk")

    out = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    chunks = spark.read.schema(_TABLE).parquet(path)
    alone = (F.col("chunk") == 0) & F.col("last")
    many = chunks.where(~alone).repartition("record").sortWithinPartitions("archive", "record", "chunk")
    return chunks.where(alone).mapInArrow(released(parse), out).unionByName(many.mapInArrow(released(parse), out))


def op8_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archive(plan_records(pages), path)
    return read_archive(spark, path).drop("url")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p),
     m AS (SELECT digest, max(page_id) AS top FROM q WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q LEFT JOIN m USING (digest)
"""
