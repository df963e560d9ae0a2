"""Asking the whole corpus about hashes, in packed rows.

Documents are dealt into chunks of a few MB by a hash of doc_id. A chunk names each of its hashes once, so a passage
that a third of all documents share is asked for once a chunk, not once a document. The hashes go to buckets by
range, as one row for each chunk and bucket that has any; a bucket answers each chunk with one bit or byte for each
hash, in the order asked, and the chunk, which derives the same hashes from the same documents again, reads them off.

Chunks and buckets are logical: their number follows the size of the input, so neither grows with it. They are dealt in
turn to at most `PARTITIONS` partitions of a shuffle, which sort and stream them one after the other, so the blocks of
a shuffle are bounded by the square of that number at any size of input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import known, parts

ASK = "step int, bucket int, chunk int, keys binary, extra binary"
ANSWER = "step int, chunk int, bucket int, bits binary"
CHUNK_BYTES = 2 << 20  # of the files read, about twice as much text
PARTITIONS = 8192


def dealt(df: DataFrame, n: int, by: str) -> DataFrame:
    """df with the n values of `by` in partitions of as many values each; they are not coalesced, as work here follows
    rows and not bytes."""
    return df.repartitionById(min(n, PARTITIONS), F.col(by))


def chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text and chunk; the number of chunks."""
    text = known(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    n = parts(text, CHUNK_BYTES)
    # Null doc_ids are spread by their text.
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return dealt(text.withColumn("chunk", F.pmod(key, F.lit(n)).cast("int")), n, "chunk"), n


def by_doc(table: pa.Table) -> pa.Table:
    """The documents of a chunk in an order that is the same whenever the chunk is read."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of 64-bit keys: n ranges of equal width."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


@dataclass
class Cuts:
    """The buckets that sorted keys fall into, and where each one's part starts; the last entry is where it ends."""

    buckets: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, buckets: np.ndarray) -> Cuts:
        at = np.flatnonzero(np.diff(buckets, prepend=-1))
        return cls(buckets[at], np.append(at, len(buckets)))

    def sizes(self) -> np.ndarray:
        return np.diff(self.at)


def ask_rows(step: int, chunk: int, cuts: Cuts, keys: np.ndarray, extra: np.ndarray) -> pa.Table:
    """A row for each bucket, with its part of keys and extra."""
    cut = list(zip(cuts.at[:-1].tolist(), cuts.at[1:].tolist(), strict=True))
    return ask_table(step, chunk, cuts.buckets, [keys[a:b].tobytes() for a, b in cut], [extra[a:b].tobytes() for a, b in cut])


def ask_table(step: int, chunk: int, buckets: np.ndarray, keys: list[bytes], extra: list[bytes]) -> pa.Table:
    same = lambda v: pa.array(np.full(len(keys), v), pa.int32())
    return pa.table({"step": same(step), "bucket": pa.array(buckets, pa.int32()), "chunk": same(chunk), "keys": pa.array(keys, pa.binary()), "extra": pa.array(extra, pa.binary())})


def per_chunk(chunks: DataFrame, fn: Callable, schema: str, answers: DataFrame | None = None, n: int = 8) -> DataFrame:
    """fn(chunk, documents) or, with answers, fn(chunk, documents, answers), for each of n chunks."""
    if answers is None:

        def alone(docs: pa.Table) -> pa.Table:
            return fn(docs.column("chunk")[0].as_py(), by_doc(docs))

        return chunks.groupBy("chunk").applyInArrow(alone, schema)

    def both(docs: pa.Table, replies: pa.Table) -> pa.Table:
        return fn(docs.column("chunk")[0].as_py(), by_doc(docs), replies) if len(docs) else nothing(schema)

    return chunks.groupBy("chunk").cogroup(dealt(answers, n, "chunk").groupBy("chunk")).applyInArrow(both, schema)


def nothing(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))})


def answer(asked: DataFrame, n: int, fns: dict[int, Callable[[list[bytes], list[bytes]], list[np.ndarray]]]) -> DataFrame:
    """fns[step](keys, extra), of lists with an item for each chunk, gives the answer to each."""

    def bucket(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        replies = fns[rows.column("step")[0].as_py()](rows.column("keys").to_pylist(), rows.column("extra").to_pylist())
        return rows.select(["step", "chunk", "bucket"]).append_column("bits", pa.array([r.tobytes() for r in replies], pa.binary()))

    return dealt(asked, n, "bucket").groupBy("bucket", "step").applyInArrow(bucket, ANSWER)


def replied(replies: pa.Table, step: int, buckets: np.ndarray, sizes: np.ndarray, bits: bool = True) -> np.ndarray:
    """The answers of these buckets in the order of the chunk's sorted keys; sizes: how many each was asked."""
    rows = zip(*(replies.column(c).to_pylist() for c in ("step", "bucket", "bits")), strict=True)
    found = {b: raw for s, b, raw in rows if s == step}
    out = []
    for b, size in zip(buckets.tolist(), sizes.tolist(), strict=True):
        raw = np.frombuffer(found[b], np.uint8)
        out.append(np.unpackbits(raw, count=size).astype(bool) if bits else raw)
    return np.concatenate(out) if out else np.zeros(0, bool if bits else np.uint8)


def split_back(flat: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(lengths)[:-1])


class Place:
    """Where in a chunk its answers belong, so that a later step need not hash the texts again: a dataclass of arrays of
    int32, kept as bytes."""

    def row(self, chunk: int) -> pa.Table:
        """As a row of step 0, which asks nothing."""
        arrays = [np.ascontiguousarray(getattr(self, f.name), np.int32) for f in fields(self)]
        return ask_table(0, chunk, np.zeros(1), [np.array([a.size for a in arrays], np.int32).tobytes() + b"".join(a.tobytes() for a in arrays)], [b""])

    @classmethod
    def read(cls, replies: pa.Table):
        (raw,) = (k for s, k in zip(replies.column("step").to_pylist(), replies.column("bits").to_pylist(), strict=True) if s == 0)
        sizes = np.frombuffer(raw, np.int32, len(fields(cls)))
        return cls(*np.split(np.frombuffer(raw, np.int32, offset=4 * len(sizes)).astype(np.int64), np.cumsum(sizes)[:-1]))


def places(asked: DataFrame) -> DataFrame:
    """The rows that Place.row made, as answers."""
    return asked.where("step = 0").select("step", "chunk", "bucket", F.col("keys").alias("bits"))
