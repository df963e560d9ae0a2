"""WARC archives: written one gzip member per record, read back sequentially.

Records of equal payloads of at least 100 bytes are kept once: the one with the smallest page_id is a response, the
others are revisits that name it. Each task streams its records into archives of its own in the shared folder; a
written manifest lists them, so archives of lost or repeated attempts are never read. The reader inflates step by step,
frames records by Content-Length and verifies the digests of block and payload, holding one step at a time.

Nulls: a null html is an empty payload, a null url an empty URI. A null page_id is written as such; among equal
payloads it is a revisit of the smallest page_id there is, or a response if there is none. Rows that share the smallest
page_id are all responses. An empty table makes no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written

LEAST = 100
ROLL = 512 << 20  # compressed bytes after which a task begins another archive
STEP = 1 << 16
TASK_BYTES = 64 << 20  # compressed, that a reading task takes
RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


# --- one record -----------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """A gzip member: a response with its payload, or a revisit with the HTTP head only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    named = lambda i: "<urn:page:%s>" % ("null" if i is None else i)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {named(page_id)}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {named(refers_to)}"]
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class Members:
    """The bytes of a stream of gzip members, inflated step by step, one member after the other."""

    def __init__(self, stream, step: int = STEP):
        self.stream, self.step, self.raw = stream, step, b""

    def next(self) -> bool:
        """Begins the next member; False at the end of the stream."""
        self.raw = self.raw or self.stream.read(self.step)
        self.z, self.held = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self) -> bytes:
        """At most a step of inflated bytes; empty at the end of the member."""
        while not self.z.eof:
            if not self.raw:
                self.raw = self.stream.read(self.step)
                if not self.raw:
                    raise ValueError("the archive ends within a record")
            out = self.z.decompress(self.raw, self.step)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out
        return b""

    def until(self, mark: bytes) -> bytes:
        """Everything before the mark, which is read too."""
        while (at := self.held.find(mark)) < 0:
            if not (more := self.more()):
                raise ValueError("a record has no end of header")
            self.held += more
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            part = self.held[:n] or self.more()[:]
            if not part:
                raise ValueError("a record is shorter than its Content-Length")
            part, rest = part[:n], part[n:]
            self.held = self.held[len(part) :] if self.held else rest
            n -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def check(said: str | None, found: str, what: str) -> None:
    if said is not None and said != f"sha256:{found}":
        raise ValueError(f"the {what} does not have its digest: {said}, not {found}")


def records(stream, keep: bool = True) -> Iterator[tuple[dict[str, str], dict[str, str], int, str, bytes]]:
    """Header, HTTP header, payload length, payload digest and (with keep) payload of each record."""
    members = Members(stream)
    while members.next():
        head = fields(members.until(b"\r\n\r\n"))
        whole, body = hashlib.sha256(), hashlib.sha256()
        http, n, kept = b"", 0, []
        inside = False
        for part in members.exactly(int(head["content-length"])):
            whole.update(part)
            if not inside:
                http += part
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    continue
                inside, part, http = True, http[at + 4 :], http[:at]
            body.update(part)
            n += len(part)
            if keep:
                kept.append(part)
        tail = b"".join(members.exactly(4))
        if tail != b"\r\n\r\n" or members.held or members.more():
            raise ValueError("a record does not end where its Content-Length says")
        check(head.get("warc-block-digest"), whole.hexdigest(), "block")
        if head["warc-type"] == "response":
            check(head.get("warc-payload-digest"), body.hexdigest(), "payload")
        yield head, fields(http), n, body.hexdigest(), b"".join(kept)


# --- Spark ------------------------------------------------------------------------------------------------------------


def write(pages: DataFrame) -> DataFrame:
    """Writes archives; their manifest: path, records, bytes."""
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    same = p.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").select("digest", "least")
    both = p.join(same, "digest", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("refers_to"))
    folder = scratch(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, size = None, "", 0, 0
        done = {"path": [], "records": [], "bytes": []}

        def close() -> None:
            out.close()
            for k, v in (("path", path), ("records", n), ("bytes", size)):
                done[k].append(v)

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, at = opened(path)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    out, n, size = store.open_output_stream(at, compression=None), 0, 0
                data = record(page_id, url, payload, digest, refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROLL:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array(done["path"], pa.string()), "records": pa.array(done["records"], pa.int64()), "bytes": pa.array(done["bytes"], pa.int64())})

    return written(both.mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """RESULT for each record of the archives."""
    number = lambda x: None if x is None or x.endswith(":null>") else int(x[10:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path, count in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, total = [], 0
                store, at = opened(path)
                with store.open_input_stream(at, compression=None) as stream:
                    for head, http, n, digest, _ in records(stream, keep=False):
                        kind = head["warc-type"]
                        if kind == "revisit":
                            n, digest = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                        rows.append((number(head["warc-record-id"]), n, digest, kind, number(head.get("warc-refers-to"))))
                        total += 1
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if total != count:
                    raise ValueError(f"{path} has {total} records, not {count}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # Small archives share a task; large ones have one each. A hash of the name deals them out.
    n, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, max(2 * manifest.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)))
    return manifest.repartitionById(tasks, F.pmod(F.xxhash64("path"), F.lit(tasks)).cast("int")).mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet")))


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to
FROM m
"""
