"""Token-ID output: sequences at places that a keyed permutation gives them, in shards of fixed stride.

1. Texts are tokenised where they are read. Their ids, each text followed by the end mark, are dealt to buckets by a
   hash of doc_id and text: buckets are ranges of the hash, sorted by it, and kept as compressed blocks. So the stream is
   the texts in the order of their hashes, whatever files, splits, buckets and machines there were, and a rerun writes
   the same shards. Each bucket sums the lengths of its blocks; the buckets' sums give every block its place.
2. The stream is cut into sequences of equal length. A Feistel network over the next power of four, walked along its
   cycle until it is within range, assigns sequence i a slot of 0 .. N - 1: a permutation that needs no table and no
   sort, and whose inverse tells which sequence a slot holds.
3. A shard holds a range of slots. Pieces of sequences go to their shard's partition, which lays them out and writes
   one file of records of equal size, so that slot s is at (s - first) * stride: training reads files from start to
   end and resumes anywhere by arithmetic. A written manifest with a digest for each file is the commit; files of
   lost attempts have names of their own and are in no manifest.

The tokenizer is a file; TRACEBED_TOKENIZER names another. Ids are two bytes, so it may have at most 65,535.
Nulls: a null text is an empty document, an end mark alone; a null doc_id is hashed as such. Only the last sequence may
be short; it is padded. Repeated rows are written as often as they occur, which is how a mix repeats epochs; rows that
are equal in doc_id and text are interchangeable. An empty table writes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, known, mix64, parts, scratch, written
from .warc import opened

TOKENIZER = os.environ.get("TRACEBED_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 2048
PER_SHARD = 8192  # slots: 32 MB
PARTITIONS = 8192  # of the shuffle that orders the stream
PAD = 0xFFFF
BLOCK = 1 << 20  # tokens
FLUSH = 8 << 20  # tokens that a task gathers before it sends them to their shards
BUCKET_BYTES = 16 << 20  # of the files read
BLOCKS = "part int, within bigint, tokens bigint, docs bigint, payload binary"
PIECES = "shard int, slots binary, starts binary, lengths binary, payload binary"
MANIFEST = "shard int, path string, slots bigint, sha256 string"
RESULT = "slot bigint, sequence bigint, shard int, byte_offset bigint, n_tokens bigint, tokens_sha256 string"


ENCODINGS: dict[bytes, tiktoken.Encoding] = {}


def encoding(data: bytes) -> tiktoken.Encoding:
    """Built once a process, which runs many tasks."""
    name = hashlib.sha256(data).digest()
    if name not in ENCODINGS:
        ENCODINGS[name] = built(data)
    return ENCODINGS[name]


def built(data: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Permutation:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: int = 0, rounds: int = 6):
        self.n, self.half = n, np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            if back:
                left, right = right ^ (mix64(left + k) & self.mask), left
            else:
                left, right = right, left ^ (mix64(right + k) & self.mask)
        return left << self.half | right

    def walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        out = self.once(np.asarray(x, np.uint64), keys, back)
        while len(far := np.flatnonzero(out >= np.uint64(self.n))):
            out[far] = self.once(out[far], keys, back)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self.walk(sequence, self.keys, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self.walk(slot, self.keys[::-1], True)


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """BLOCKS of the stream."""
    with open(tokenizer, "rb") as f:
        data = f.read()
    if (end := len(data.splitlines())) >= PAD:
        raise ValueError(f"{tokenizer} has {end} ids; two bytes hold {PAD - 1} besides the padding")
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(sent.value).encode_ordinary
        for batch in batches:
            found = []
            for text in batch.column("text"):
                found.append(np.array([*encode(text.as_py() or ""), end], np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], ["key", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, within, held, size, n = -1, 0, [], 0, 0
        squeeze = zstandard.ZstdCompressor(level=3)

        def packed() -> pa.RecordBatch:
            payload = squeeze.compress(b"".join(held))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "within": pa.array([within], pa.int64()), "tokens": pa.array([size], pa.int64()), "docs": pa.array([n], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            for bucket, ids in zip(batch.column("bucket").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if bucket != part or size >= BLOCK:
                    if held:
                        yield packed()
                    within = within + size if bucket == part else 0
                    part, held, size, n = bucket, [], 0, 0
                held.append(ids)
                size, n = size + len(ids) // 2, n + 1
        if held:
            yield packed()

    slim = known(docs.select("doc_id", "text"))
    n = min(parts(slim, BUCKET_BYTES), PARTITIONS)  # a bucket is sorted with spills and streamed, so it may be large
    # The hash without its sign; the bucket is its range of n.
    key = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 63) - 1))
    ids = slim.select(key.alias("key"), "text").mapInArrow(tokenise, "key bigint, ids binary")
    dealt = ids.withColumn("bucket", F.expr(f"cast((key >> 32) * {n} >> 31 as int)")).repartitionById(n, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "key", "ids").select("bucket", "ids").mapInArrow(pack, BLOCKS)


def ahead(blocks: DataFrame) -> dict[int, int]:
    """For each bucket the tokens of those before it: a number for each."""
    sizes, before, total = blocks.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect(), {}, 0
    for row in sizes:
        before[row.part] = total
        total += row.n
    return before


def shards(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = 42, tokenizer: str = TOKENIZER) -> tuple[DataFrame, Permutation | None]:
    """Writes the shards; their manifest, and the permutation."""
    spark = docs.sparkSession
    blocks = written(tokenised(docs, tokenizer), "tokens")
    total = blocks.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], MANIFEST), None
    n = -(-total // length)
    order = Permutation(n, key)
    count = -(-n // per_shard)
    folder = scratch(spark, "shards")
    before = spark.sparkContext.broadcast(ahead(blocks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, loosen = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([t for _, t in held])
            begin = np.cumsum([0, *(len(t) for _, t in held)])
            at, seq, first, size = [], [], [], []
            for (start, t), b in zip(held, begin[:-1].tolist(), strict=True):
                own = np.arange(start // length, (start + len(t) - 1) // length + 1)
                lo, hi = np.maximum(own * length, start), np.minimum((own + 1) * length, start + len(t))
                at.append(lo - start + b)
                seq.append(own)
                first.append(lo - own * length)
                size.append(hi - lo)
            at, seq, first, size = map(np.concatenate, (at, seq, first, size))
            slot = order.slot(seq)
            by = np.argsort(slot, kind="stable")
            at, slot, first, size = at[by], slot[by], first[by].astype(np.int32), size[by].astype(np.int32)
            shard = slot // per_shard
            cut = np.append(np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))), len(shard))
            out = {k: [] for k in ("shard", "slots", "starts", "lengths", "payload")}
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                out["shard"].append(int(shard[a]))
                out["slots"].append(slot[a:b].tobytes())
                out["starts"].append(first[a:b].tobytes())
                out["lengths"].append(size[a:b].tobytes())
                out["payload"].append(squeeze.compress(b"".join(tokens[i : i + m].tobytes() for i, m in zip(at[a:b].tolist(), size[a:b].tolist(), strict=True))))
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "shard" else pa.binary()) for k, v in out.items()})

        size = 0
        for batch in batches:
            for part, within, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "within", "payload")), strict=True):
                held.append((before.value[part] + within, np.frombuffer(loosen.decompress(payload), np.uint16)))
                size += len(held[-1][1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen, open_shards = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for shard, slots, starts, lengths, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "slots", "starts", "lengths", "payload")), strict=True):
                if shard not in open_shards:  # a partition has one shard
                    open_shards[shard] = np.full((min(per_shard, n - shard * per_shard), length), PAD, np.uint16)
                records, at = open_shards[shard].reshape(-1), 0
                tokens = np.frombuffer(loosen.decompress(payload), np.uint16)
                for s, f, m in zip((np.frombuffer(slots, np.int64) - shard * per_shard).tolist(), np.frombuffer(starts, np.int32).tolist(), np.frombuffer(lengths, np.int32).tolist(), strict=True):
                    records[s * length + f : s * length + f + m] = tokens[at : at + m]
                    at += m
        for shard, records in open_shards.items():
            path = f"{folder}/{shard:08d}-{uuid.uuid4().hex}.bin"
            store, at = opened(path)
            store.create_dir(at.rpartition("/")[0], recursive=True)
            data = records.tobytes()
            with store.open_output_stream(at, compression=None) as out:
                out.write(data)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "slots": pa.array([len(records)], pa.int64()), "sha256": [hashlib.sha256(data).hexdigest()]})

    pieces = blocks.select("part", "within", "payload").mapInArrow(deal, PIECES)
    manifest = written(pieces.repartitionById(count, F.col("shard")).mapInArrow(lay, MANIFEST), "manifest")
    drop(spark, blocks._table)
    return manifest, order


def records(path: str, length: int, start: int = 0) -> Iterator[np.ndarray]:
    """The sequences of a shard from record `start` on, read in order."""
    store, at = opened(path)
    stride = 2 * length
    with store.open_input_file(at) as f:
        f.seek(start * stride)
        while data := f.read(256 * stride):
            yield from np.frombuffer(data, np.uint16).reshape(-1, length)


def read(manifest: DataFrame, order: Permutation | None, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """RESULT for each slot, read back from the shards."""
    if order is None:
        return manifest.sparkSession.createDataFrame([], RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, slots, sha in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "slots", "sha256")), strict=True):
                whole, sizes, digests = hashlib.sha256(), [], []
                for r in records(path, length):
                    whole.update(r)
                    own = r[r != PAD]
                    sizes.append(len(own))
                    digests.append(hashlib.sha256(own.tobytes()).hexdigest())
                if len(sizes) != slots or whole.hexdigest() != sha:
                    raise ValueError(f"{path} is not what was written")
                slot = np.arange(slots) + shard * per_shard
                yield pa.RecordBatch.from_pydict(
                    {"slot": slot, "sequence": order.sequence(slot), "shard": pa.array(np.full(slots, shard), pa.int32()), "byte_offset": np.arange(slots) * 2 * length, "n_tokens": pa.array(sizes, pa.int64()), "tokens_sha256": pa.array(digests, pa.string())}
                )

    return manifest.repartition(max(1, manifest.count()), "shard").mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(*shards(spark.read.parquet(f"{sf_dir}/documents.parquet")))
