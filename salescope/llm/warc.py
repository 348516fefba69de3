"""Operator 8: a deterministic sharded WARC writer, and its reader.

Records are dealt by fixed ranges of page_id (``ids_per_shard``) and sorted inside, so the archives'
bytes depend on the table alone, not on a sample, the cluster or a retry. A task writes its shards one after
the other; a file is rolled when its compressed size reaches ``roll_bytes``. Headers, record
ids and digests are made anew from the payload. Each record is its own gzip member.

A file is written under a temporary name and renamed when complete; a retried task
writes the same bytes under the same final name. The manifest (file, records, bytes, sha256) is a Parquet table that
Spark commits last; a reader opens only files that the manifest lists, and checks every
response's digest.

Payloads of at least ``MIN_SHARED`` bytes are compared by SHA-256 over all pages: the smallest page_id has the
response, the others are revisits that refer to it.

Defined cases: a null html is empty; a null url gives a record without target; control
characters in a url are percent-escaped; a null page_id is the largest and goes to a shard of its own, and a
revisit that refers to it has no refers_to; rows that repeat page_id and payload are all of the
same type; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm.common import attach, broadcast_if_small, ship, stored, table
from salescope.session import scratch_path

ship(__name__)

MIN_SHARED = 100
IDS_PER_SHARD = 1024
ROLL_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
OUT_BYTES = 4 << 20
PRINTABLE = "".join(map(chr, range(33, 127)))


def record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, page + ' ' + digest)}>"


def record(page, url, payload: bytes, refers_to, revisit: bool) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(str(page), digest)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=PRINTABLE)}")
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(str(refers_to), digest)}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Roller:
    """Writes records to files that are rolled by compressed size."""

    def __init__(self, uri: str, roll_bytes: int):
        self.uri, self.roll_bytes, self.out = uri, roll_bytes, None

    def add(self, shard: str, data: bytes):
        """Yields the manifest row of a file that this record closes."""
        if self.out is not None and (shard != self.shard or self.size >= self.roll_bytes):
            after = self.number + 1 if shard == self.shard else 0
            yield self.close()
            self.open(shard, after)
        elif self.out is None:
            self.open(shard, 0)
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def open(self, shard: str, number: int):
        self.shard, self.number, self.size, self.records = shard, number, 0, 0
        self.sha = hashlib.sha256()
        self.name = f"{shard}-{number:05d}.warc.gz"
        self.fs, base = fs.FileSystem.from_uri(self.uri)
        self.fs.create_dir(base, recursive=True)
        self.temporary, self.final = f"{base}/.{self.name}.{uuid.uuid4().hex}.tmp", f"{base}/{self.name}"
        self.out = self.fs.open_output_stream(self.temporary)

    def close(self):
        self.out.close()
        self.fs.move(self.temporary, self.final)
        self.out = None
        return self.name, self.records, self.size, self.sha.hexdigest()


def write_warc(pages: DataFrame, uri: str, ids_per_shard: int = IDS_PER_SHARD, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``uri``; returns the manifest: file, records, bytes, sha256."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= MIN_SHARED, F.sha2("html", 256)))
    groups = rows.filter("digest is not null").groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages"))
    groups = stored(groups.filter("pages > 1"), "warc-groups")
    # only ids and digests take part in the skew-safe join; html goes through one shuffle
    keys = rows.filter("digest is not null").select("page_id", "digest")
    found = attach(keys, groups, "digest", "pages", F.lit(pages.count())).filter("pages is not null")
    found = found.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first", F.lit(True).alias("shared")).distinct()
    found = broadcast_if_small(stored(found.filter(~F.col("_p").eqNullSafe(F.col("first"))), "warc-revisits"))
    rows = rows.join(found, rows["page_id"].eqNullSafe(F.col("_p")) & (rows["digest"] == F.col("_d")), "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    shard = F.floor(F.col("page_id") / ids_per_shard)
    name = F.coalesce(F.concat(F.when(shard < 0, "m").otherwise("p"), F.lpad(F.abs(shard).cast("string"), 16, "0")), F.lit("unknown"))
    rows = rows.select(name.alias("shard"), "page_id", "url", "html", "first", revisit.alias("revisit"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "page_id", "url", "html")

    def write(batches):
        files = Roller(uri, roll_bytes)
        done = []
        for batch in batches:
            for i in range(batch.num_rows):
                shard, page, url, html, first, again = (c[i].as_py() for c in batch.columns)
                done += files.add(shard, record(page, url, html.encode(), first, again))
        if files.out is not None:
            done.append(files.close())
        name, records, size, sha = zip(*done) if done else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(name, pa.string()), pa.array(records, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string())],
            ["file", "records", "bytes", "sha256"],
        )

    manifest = rows.mapInArrow(write, "file string, records long, bytes long, sha256 string")
    manifest.write.parquet(f"{uri}/manifest")
    return pages.sparkSession.read.parquet(f"{uri}/manifest")


def records(stream):
    """(headers, payload) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[key] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("record is cut short")
        yield head, block.partition(b"\r\n\r\n")[2]


def read_warc(spark: SparkSession, uri: str) -> DataFrame:
    """Records of the files that the manifest lists: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload."""

    def read(batches):
        where, base = fs.FileSystem.from_uri(uri)
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        whole = lambda x: None if x is None else int(x)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with gzip.GzipFile(fileobj=where.open_input_file(f"{base}/{name}")) as f:
                    for head, payload in records(f):
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload digest differs in {name}")
                        rows.append((
                            whole(head.get("X-Page-ID")), head.get("WARC-Target-URI"), kind, int(head["X-Payload-Length"]), digest,
                            whole(head.get("X-Refers-To-Page")), payload if kind == "response" else None,
                        ))
                        size += len(payload)
                        if size >= OUT_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    # a number of its own: the few rows of a manifest would be folded into one task, which then read all files
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.parquet(f"{uri}/manifest").select("file").repartition(tasks, "file")
    return files.mapInArrow(
        read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch_path(spark, "llm", f"warc-{uuid.uuid4().hex}")
    uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    write_warc(table(spark, sf_dir, "pages"), uri)
    return read_warc(spark, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest,
    min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM q
"""
