"""Suffix-array dedup on bytes: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A 200-byte string that occurs twice has the same smallest 100-byte gram in both places (the rightmost of equals), so
strings are grouped by that gram: consecutive strings of a document with one smallest gram are a segment, at most 300
bytes long. The groups come together by packed exchange (packed.py):

1. Each chunk names its grams, and how many different segments it has of each. A gram found once is unique text.
2. The text of all other segments goes to the gram's bucket. Equal texts are one, with a weight. A suffix array of the
   texts of a bucket gives the Burrows-Wheeler transform; breadth-first backward extension of intervals sets common
   prefixes by increasing length and stops at the threshold. Neighbouring rows that are not told apart by then, and
   rows of weight, are strings that repeat: bytes decide, for copies of whole segments too.
3. A gram that is asked for more than `GROUP` times (a passage in very many contexts) would make its bucket as large as
   the passage is common. Its strings are dealt out one by one, by 128 bits of XXH3 of their bytes.

Nulls: a null text is empty; a null doc_id is an ordinary document. Repeated rows are places of their own, so each loses
what it shares with the other. Texts under 200 bytes lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import mix64, slices, utf8, written
from .packed import ASK, Cuts, Place, answer, ask_rows, ask_table, bucket_of, chunked, per_chunk, places, replied, split_back

NEED = 200
GROUP = 4096  # segments of one gram that a bucket takes as text
PIECE = 1 << 16  # bytes of text that are hashed at a time; what is derived from them stays in cache
BATCH = 1 << 18  # bytes of segments in one transform
BASE = 0x9E3779B97F4A7C15
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
POWERS: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64; kept for the next call."""
    if len(POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            terms = np.full(n, base, np.uint64)
            terms[0] = 1
            POWERS[k] = np.multiply.accumulate(terms)
    return [p[:n] for p in POWERS]


def grams(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes, from prefix sums of a polynomial. Grams that share one only meet in one group."""
    up, down = powers(len(buf) + 1)
    terms = buf.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[:-1]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))
    h = sums[k:] - sums[:-k]
    h *= down[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window, from minima of windows of powers of two."""
    n, have = len(values) - width + 1, 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:n], values[width - have :][:n])


def pieces(off: np.ndarray):
    """Byte ranges of whole documents, or of parts of a long one that overlap by a string; and their documents."""
    for i, j in slices(off, PIECE):
        lo, end = int(off[i]), int(off[j])
        while lo < end:
            hi = end if end - lo <= 2 * PIECE else lo + PIECE + NEED - 1
            yield lo, hi, i, j
            lo = end if hi == end else hi - NEED + 1


def segments(buf: np.ndarray, off: np.ndarray, need: int = NEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment: gram, start, and the end of its last string."""
    gram = need // 2
    width = need - gram + 1
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi, i, j in pieces(off):
        if hi - lo < need:
            continue
        b = buf[lo:hi]
        g = grams(b, gram)
        mask = np.uint64((1 << 22) - 1)
        back = mask - np.arange(len(g), dtype=np.uint64)
        at = (mask - (smallest((g & ~mask) | back, width) & mask)).astype(np.int64)
        bad = np.zeros(len(b) + 1, np.int32)  # starts of strings that would cross the end of a document
        ends = off[i + 1 : j + 1] - lo
        ends = ends[(ends > 0) & (ends < len(b))]
        np.add.at(bad, np.maximum(ends - need + 1, 0), 1)
        np.add.at(bad, ends, -1)
        start = np.flatnonzero(np.cumsum(bad)[: len(at)] == 0)
        if not len(start):
            continue
        anchor = at[start]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
        last = start[np.concatenate((new[1:], [True]))]
        # Minima crowd at the low end; mixed again they fill all buckets alike.
        found.append((mix64(g[anchor[new]]), start[new] + lo, last + need + lo))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# --- the transform ------------------------------------------------------------------------------------------------


def suffix_array(symbols: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """By prefix doubling. symbols: 0 ends a text; left: symbols up to that end. Suffixes that are equal up to their ends are in the order of their places."""
    n = len(symbols)
    at = np.arange(n)
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = key << np.uint64(9)
        if j < n:
            key[: n - j] |= np.where(left[: n - j] >= j, symbols[j:], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    head = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    h = 7
    while h <= longest:
        tied = ~head | ~np.concatenate((head[1:], [True]))
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        here = order[rows]
        follow = np.where(left[here] >= h, rank[np.minimum(here + h, n - 1)] + 1, 0)
        by = np.argsort((rank[here].astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64), kind="stable")
        here, follow = here[by], follow[by]
        order[rows] = here
        group = rank[here]
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])))
        head[rows] = fresh
        rank[here] = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
        h *= 2
    return order


def expand_intervals(bwt: np.ndarray, ends: int, need: int) -> np.ndarray:
    """Whether each row of the transform shares fewer than `need` symbols with the row above.

    An interval holds the rows that start with one string. A queue of intervals, all of one length, is extended
    backwards, by each symbol that precedes a row of it; where the extended interval ends, the row below has a common
    prefix of just the queue's length, unless a shorter one was set there before. Only intervals that set one go into
    the next queue, and the queue of length `need` is never made: what is not set by then shares `need` symbols."""
    n = len(bwt)
    follow = np.argsort(bwt, kind="stable")  # row of the suffix that starts one symbol later
    to = np.empty(n, np.int64)
    to[follow] = np.arange(n)  # row of the suffix that starts one symbol earlier
    first = bwt[follow]
    apart = np.concatenate(([True], first[1:] != first[:-1], [True]))
    apart[: ends + 1] = True  # each end is a symbol of its own
    low = np.flatnonzero(apart[:-1])
    high = np.append(low[1:], n) - 1
    for _ in range(1, need):
        if not len(low):
            break
        size = high - low + 1
        name = np.repeat(np.arange(len(low)), size)
        rows = np.repeat(low - np.cumsum(size) + size, size) + np.arange(len(name))
        inner = bwt[rows] > 0  # no string goes on before the start of its text
        rows, name = rows[inner], name[inner]
        order = np.argsort(to[rows], kind="stable")
        rows, name = rows[order], name[order]
        place, symbol = to[rows], bwt[rows]
        new = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (symbol[1:] != symbol[:-1])))) if len(rows) else np.zeros(0, np.int64)
        low, high = place[new], place[np.append(new[1:], len(rows)) - 1] if len(rows) else new
        fresh = ~apart[high + 1]
        low, high = low[fresh], high[fresh]
        apart[high + 1] = True
    return apart[:-1]


def repeated(texts: list[bytes], need: int = NEED) -> list[np.ndarray]:
    """For each text, whether each of its strings of `need` bytes is also found at another place of these texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    if not len(texts):
        return []
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    stop = np.cumsum(lengths + 1) - 1
    symbols = raw.astype(np.int64) + 1
    symbols[stop] = 0
    left = np.repeat(stop, lengths + 1) - np.arange(len(raw))
    sa = suffix_array(symbols, left, int(lengths.max()) + 1)
    bwt = symbols[sa - 1].astype(np.uint16)
    # The array begins with the ends, one row for each text.
    apart = expand_intervals(bwt, len(texts), need)
    alone = apart & np.concatenate((apart[1:], [True]))
    twice = np.zeros(len(raw), bool)
    twice[sa[~alone]] = True
    starts = stop - lengths
    return [twice[s : s + max(0, m - need + 1)] for s, m in zip(starts.tolist(), lengths.tolist(), strict=True)]


# --- what buckets answer --------------------------------------------------------------------------------------------

ALONE, TEXT, STRINGS = 0, 1, 2


def met(keys: list[bytes], counts: list[bytes]) -> list[np.ndarray]:
    """Of each gram: ALONE, TEXT, or STRINGS if it is asked for too often."""
    gram, often = np.concatenate([np.frombuffer(k, np.uint64) for k in keys]), np.concatenate([np.frombuffer(c, np.uint32) for c in counts])
    order = np.argsort(gram, kind="stable")
    new = np.concatenate(([True], gram[order][1:] != gram[order][:-1]))
    total = np.add.reduceat(often[order].astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.empty(len(gram), np.uint8)
    out[order] = np.where(total > GROUP, STRINGS, np.where(total > 1, TEXT, ALONE))
    return split_back(out, [len(k) // 8 for k in keys])


def packed_texts(texts: list[bytes], twice: np.ndarray) -> bytes:
    return np.array([len(t) for t in texts], np.uint32).tobytes() + twice.astype(np.uint8).tobytes() + b"".join(texts)


def expand(keys: list[bytes], packed: list[bytes]) -> list[np.ndarray]:
    """For the strings of each segment, whether they repeat. packed: lengths, whether the chunk has it twice, bytes."""
    group: dict[int, dict[bytes, int]] = {}  # of a gram, the different texts
    texts: list[bytes] = []
    weights: list[int] = []
    own: list[list[int]] = []
    for k, raw in zip(keys, packed, strict=True):
        m, rows = len(k) // 8, []
        twice = raw[4 * m : 5 * m]
        begin = 5 * m
        for gram, size, more in zip(np.frombuffer(k, np.uint64).tolist(), np.frombuffer(raw, np.uint32, m).tolist(), twice, strict=True):
            text = raw[begin : begin + size]
            begin += size
            known = group.setdefault(gram, {})
            i = known.setdefault(text, len(texts))
            if i == len(texts):
                texts.append(text)
                weights.append(0)
            weights[i] += 1 + more
            rows.append(i)
        own.append(rows)
    found: list[np.ndarray | None] = [None] * len(texts)
    batch: list[int] = []
    size = 0

    def run() -> None:
        for i, hit in zip(batch, repeated([texts[i] for i in batch]), strict=True):
            found[i] = hit | (weights[i] > 1)

    for known in group.values():
        if len(known) == 1:  # a transform of one text says no more than its weight
            ((text, i),) = known.items()
            found[i] = np.full(len(text) - NEED + 1, weights[i] > 1)
            continue
        batch += known.values()
        size += sum(map(len, known))
        if size > BATCH:
            run()
            batch, size = [], 0
    run()
    return [np.packbits(np.concatenate([found[i] for i in rows])) for rows in own]


def count_strings(keys: list[bytes], many: list[bytes]) -> list[np.ndarray]:
    flat = np.concatenate([np.frombuffer(k, np.uint64).reshape(-1, 2) for k in keys])
    twice = np.concatenate([np.frombuffer(k, np.uint8) for k in many]) > 0
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    f = flat[order]
    new = np.concatenate(([True], (f[1:] != f[:-1]).any(axis=1)))
    at = np.flatnonzero(new)
    hit = ((np.diff(np.append(at, len(f))) > 1) | np.logical_or.reduceat(twice[order], at))[np.cumsum(new) - 1]
    out = np.empty(len(f), bool)
    out[order] = hit
    return [np.packbits(x) for x in split_back(out, [len(k) // 16 for k in keys])]


# --- what chunks ask ------------------------------------------------------------------------------------------------


class Chunk:
    """The segments of a chunk: places of the different ones, equal bytes being one, by gram."""

    def __init__(self, docs: pa.Table, n: int):
        self.buf, self.off = utf8(docs.column("text"))
        self.data = self.buf.tobytes()
        gram, self.p1, self.p2 = segments(self.buf, self.off)
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        new = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
        count = np.diff(np.append(np.flatnonzero(new), len(g)))
        self.which = np.empty(len(g), np.int64)  # the different segment that each is
        self.first, self.grams, self.twice = [], [], []  # of the different ones: a place, the gram, whether it is found twice
        single = np.repeat(count == 1, count)
        at = np.flatnonzero(single)
        self.which[order[at]] = np.arange(len(at))
        first, grams_, twice = [order[at]], [g[at]], np.zeros(len(at), bool)
        more, seen = [], {}
        for i in order[~single].tolist():
            key = (gram[i], self.data[self.p1[i] : self.p2[i]])
            k = seen.setdefault(key, len(seen))
            if k == len(more):
                more.append(i)
            self.which[i] = len(at) + k
        often = np.bincount(self.which[order[~single]] - len(at), minlength=len(more)) if len(more) else np.zeros(0, np.int64)
        first, grams_, twice = np.concatenate([*first, np.array(more, np.int64)]), np.concatenate([*grams_, gram[np.array(more, np.int64)]]), np.concatenate([twice, often > 1])
        by = np.argsort(grams_, kind="stable")
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        self.first, self.grams, self.twice, self.which = first[by], grams_[by], twice[by], back[self.which]
        new = np.concatenate(([True], self.grams[1:] != self.grams[:-1])) if len(by) else np.zeros(0, bool)
        self.name = np.cumsum(new) - 1  # of each different segment, which of the grams
        self.asked = self.grams[new]
        # A segment found twice counts as two.
        self.counts = np.bincount(self.name, weights=1 + self.twice, minlength=len(self.asked)).astype(np.uint32)
        self.cuts = Cuts.of(bucket_of(self.asked, n))

    def texts(self, of: np.ndarray) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.p1[self.first[of]].tolist(), self.p2[self.first[of]].tolist(), strict=True)]

    def strings(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the strings of these segments, at all their places: starts and which key each has; the keys, and which the chunk has twice."""
        mine = np.flatnonzero(np.isin(self.which, of))
        starts, keys, seen = [], [], {}
        for a, b in zip(self.p1[mine].tolist(), self.p2[mine].tolist(), strict=True):
            for i in range(a, b - NEED + 1):
                starts.append(i)
                keys.append(seen.setdefault(xxhash.xxh3_128_digest(self.data[i : i + NEED]), len(seen)))
        flat = np.frombuffer(b"".join(seen), np.uint64).reshape(-1, 2)
        by = np.lexsort((flat[:, 1], flat[:, 0]))
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        which = back[np.array(keys, np.int64)]
        return np.array(starts, np.int64), which, flat[by], np.bincount(which, minlength=len(by)) > 1


@dataclass
class Sent(Place):
    """What a chunk has sent as text, and as strings."""

    start: np.ndarray  # of each segment at each place
    which: np.ndarray  # of those sent, in the order asked
    strings: np.ndarray  # in each of those sent
    buckets: np.ndarray
    sizes: np.ndarray  # strings in each bucket
    hot_start: np.ndarray
    hot_which: np.ndarray
    hot_buckets: np.ndarray
    hot_sizes: np.ndarray


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """RESULT for each document: bytes in a 200-byte string that starts anywhere else too are removed."""
    chunks, n = chunked(docs)

    def name(chunk: int, table: pa.Table) -> pa.Table:
        c = Chunk(table, n)
        return ask_rows(1, chunk, c.cuts, c.asked, c.counts)

    def send(chunk: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        c = Chunk(table, n)
        status = replied(replies, 1, c.cuts.buckets, c.cuts.sizes(), bits=False)[c.name]
        text = np.flatnonzero(status == TEXT)
        cuts, parts = Cuts.of(bucket_of(c.grams[text], n)), []
        for a, b in zip(cuts.at[:-1].tolist(), cuts.at[1:].tolist(), strict=True):
            parts.append(packed_texts(c.texts(text[a:b]), c.twice[text[a:b]]))
        keys = [c.grams[text[a:b]].tobytes() for a, b in zip(cuts.at[:-1].tolist(), cuts.at[1:].tolist(), strict=True)]
        count = c.p2[c.first[text]] - c.p1[c.first[text]] - NEED + 1
        place = np.full(len(c.first), -1)
        place[text] = np.arange(len(text))
        mine = np.flatnonzero(place[c.which] >= 0) if len(c.which) else np.zeros(0, np.int64)
        starts, which, strings, twice = c.strings(np.flatnonzero(status == STRINGS))
        hot = Cuts.of(bucket_of(strings[:, 0], n))
        sent = Sent(c.p1[mine], place[c.which[mine]], count, cuts.buckets, np.add.reduceat(count, cuts.at[:-1]) if len(count) else count, starts, which, hot.buckets, hot.sizes())
        return pa.concat_tables([sent.row(chunk), ask_table(2, chunk, cuts.buckets, keys, parts), ask_rows(3, chunk, hot, strings, twice.astype(np.uint8))])

    def remove(chunk: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        buf, off = utf8(table.column("text"))
        sent = Sent.read(replies)
        edge = np.zeros(len(buf) + 1, np.int32)
        hit = replied(replies, 2, sent.buckets, sent.sizes)
        count = sent.strings[sent.which]
        first = np.concatenate(([0], np.cumsum(sent.strings)))[sent.which]
        hot = replied(replies, 3, sent.hot_buckets, sent.hot_sizes)[sent.hot_which]
        for start in (runs(sent.start, count)[hit[runs(first, count)]], sent.hot_start[hot]):
            np.add.at(edge, start, 1)
            np.add.at(edge, start + NEED, -1)
        gone = np.cumsum(edge[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[off[1:]] - total[off[:-1]]
        spans, digests = [], []
        for d, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            if removed[d]:
                own = gone[a:b]
                spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()))
                digests.append(hashlib.sha256(buf[a:b][~own].tobytes()).hexdigest())
            else:
                spans.append(0)
                digests.append(hashlib.sha256(buf[a:b]).hexdigest())
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": np.diff(off), "n_removed": removed, "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    named = written(answer(per_chunk(chunks, name, ASK), n, {1: met}), "suffixes")
    asked = written(per_chunk(chunks, send, ASK, named, n), "suffixes", supersedes=named)
    found = written(answer(asked.where("step > 0"), n, {2: expand, 3: count_strings}), "suffixes")
    return per_chunk(chunks, remove, RESULT, places(asked).unionByName(found), n)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
