"""Substring dedup on words: fixed-block anchors.

A window of 13 words holds a whole block of 7 words that starts at a multiple of 7, wherever the window starts. So
every document's aligned blocks are the index, and every rolling window of 7 words of every document probes it
(step 1). Around each hit the repeat is extended word by word to both sides as far as a window of 13 reaches: each of
the at most seven windows about a hit asks which smallest document holds it (step 2), and windows in a row make up the
maximal exact repeats. Steps are exchanged in packed rows (packed.py), so that no pair of documents is ever listed.

Words enter by two hashes of their bytes, of any length (common.word_hashes). Hits of step 1 compare 32 bits within a bucket and only propose
windows; step 2 decides by 128 bits, of two independent hashes of every word.

Nulls: a null text has no words; a null doc_id ranks after all others. Documents of equal doc_id do not remove each
other's words. Empty texts keep the hash of the empty string; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import hashed_texts, ids, utf8, windows, written
from .packed import ASK, Cuts, Place, answer, ask_rows, bucket_of, chunked, per_chunk, places, replied, split_back

STEP1, STEP2, STEP3 = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x9E3779B97F4A7C15
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


class Chunk:
    """What both steps derive from the documents of a chunk."""

    def __init__(self, docs: pa.Table, n: int, window: int, block: int):
        each = list(hashed_texts(*utf8(docs.column("text"))))
        self.words, self.doc = np.concatenate([np.zeros((0, 2), np.uint64), *each]), np.repeat(np.arange(len(docs)), [len(h) for h in each])
        h = windows(self.words[:, 0], block, STEP1)
        self.at = np.flatnonzero(self.doc[: len(h)] == self.doc[block - 1 :][: len(h)])
        h, doc = h[self.at], self.doc[self.at]
        self.keys, first, self.inverse = np.unique((bucket_of(h, n).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)), return_index=True, return_inverse=True)
        self.cuts = Cuts.of((self.keys >> np.uint64(32)).astype(np.int64))
        begin = np.searchsorted(self.doc, np.arange(len(docs)))  # first word of each document
        aligned, many = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        aligned[self.inverse[(self.at - begin[doc]) % block == 0]] = True
        many[self.inverse[doc != doc[first][self.inverse]]] = True
        self.kind = aligned + 2 * many.astype(np.uint8)
        self.window, self.block = window, block

    def extended(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows about live blocks start, and the keys of these windows."""
        hit = np.zeros(len(self.words) + 1, np.int64)
        hit[self.at[live[self.inverse]] + 1] = 1
        hit = np.cumsum(hit)
        n = max(0, len(self.words) - self.window + 1)
        reach = self.window - self.block + 1
        at = np.flatnonzero((self.doc[:n] == self.doc[self.window - 1 :][:n]) & (hit[reach : reach + n] > hit[:n]))
        return at, np.stack((windows(self.words[:, 0], self.window, STEP2)[at], windows(self.words[:, 1], self.window, STEP3)[at]), axis=1)


def live_blocks(keys: list[bytes], kinds: list[bytes]) -> list[np.ndarray]:
    """Whether each block is in the index and in another document."""
    flat, kind = np.concatenate([np.frombuffer(k, np.uint32) for k in keys]), np.concatenate([np.frombuffer(k, np.uint8) for k in kinds])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    aligned, many = np.zeros(len(count), bool), count > 1
    aligned[inverse[kind & 1 > 0]] = True
    many[inverse[kind & 2 > 0]] = True
    return [np.packbits(x) for x in split_back((aligned & many)[inverse], [len(k) // 4 for k in keys])]


def heads(keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, whether each differs from the one above."""
    return np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else np.zeros(0, bool)


def held_before(keys: list[bytes], docs: list[bytes]) -> list[np.ndarray]:
    """Whether a document before the asking chunk's first holds the window."""
    flat, doc = np.concatenate([np.frombuffer(k, np.uint64).reshape(-1, 2) for k in keys]), np.concatenate([np.frombuffer(d, np.int64) for d in docs])
    order = np.lexsort((doc, flat[:, 1], flat[:, 0]))
    head = heads(flat[order])
    least = np.empty(len(flat), np.int64)
    least[order] = doc[order][head][np.cumsum(head) - 1]
    return [np.packbits(x) for x in split_back(least < doc, [len(k) // 16 for k in keys])]


def covered(n: int, at: np.ndarray, width: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


@dataclass
class Found(Place):
    """The windows about live blocks."""

    at: np.ndarray
    key: np.ndarray  # of each window, which of the keys asked
    own: np.ndarray  # whether the chunk itself has it in an earlier document
    buckets: np.ndarray
    sizes: np.ndarray


def dedup_words(docs: DataFrame, window: int = 13) -> DataFrame:
    """RESULT for each document: words that an earlier document's window covers are removed."""
    block = (window + 1) // 2
    chunks, n = chunked(docs)

    def probe(chunk: int, table: pa.Table) -> pa.Table:
        c = Chunk(table, n, window, block)
        return ask_rows(1, chunk, c.cuts, c.keys.astype(np.uint32), c.kind.astype(np.uint8))

    def extend(chunk: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        c, doc_ids = Chunk(table, n, window, block), ids(table.column("doc_id"))
        at, keys = c.extended(replied(replies, 1, c.cuts.buckets, c.cuts.sizes()))
        order = np.lexsort((at, keys[:, 1], keys[:, 0]))  # of equal windows the one in the smallest document comes first
        head = heads(keys[order])
        inverse = np.empty(len(at), np.int64)
        inverse[order] = np.cumsum(head) - 1
        asked, first = keys[order][head], doc_ids[c.doc[at[order][head]]]
        cuts = Cuts.of(bucket_of(asked[:, 0], n))
        found = Found(at, inverse, first[inverse] < doc_ids[c.doc[at]], cuts.buckets, cuts.sizes())
        return pa.concat_tables([found.row(chunk), ask_rows(2, chunk, cuts, asked, first)])

    def remove(chunk: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        found = Found.read(replies)
        before = replied(replies, 2, found.buckets, found.sizes)[found.key] | (found.own > 0)
        (buf, off), at = utf8(table.column("text")), found.at[before]
        data, counts, removed, digests, begin = buf.tobytes(), [], [], [], 0
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            words = data[a:b].split()
            counts.append(len(words))
            lo, hi = np.searchsorted(at, (begin, begin + len(words)))
            begin += len(words)
            if hi > lo:
                gone = covered(len(words), at[lo:hi] - begin + len(words), window)
                removed.append(int(gone.sum()))
                words = compress(words, (~gone).tolist())
            else:
                removed.append(0)
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    named = written(answer(per_chunk(chunks, probe, ASK), n, {1: live_blocks}), "blocks")
    asked = written(per_chunk(chunks, extend, ASK, named, n), "blocks", supersedes=named)
    found = written(answer(asked.where("step > 0"), n, {2: held_before}), "blocks")
    return per_chunk(chunks, remove, RESULT, places(asked).unionByName(found), n)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM w),
g AS (SELECT doc_id, i, list_slice(words, i, i + 12) AS win FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM m WHERE least < doc_id),
r AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    sha256(CASE WHEN gone IS NULL THEN array_to_string(words, ' ')
        ELSE coalesce(array_to_string([x[1] FOR x IN list_zip(words, range(1, len(words) + 1)) IF NOT list_contains(gone, x[2])], ' '), '') END) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
