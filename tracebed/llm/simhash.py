"""SimHash near-dedup with pigeonring filtering.

A fingerprint has bit i set if more than half of the shingles' hashes have. Cut two fingerprints that differ in at most
2 bits into four segments on a ring: from some segment on, every chain of consecutive segments stays within its share
of the differences, which is 0 for one segment, 1 for two and three, and 2 for all. So that first segment is equal, and
of the two after it one is equal as well: a pair of equal segments is the key under which candidates meet. The third
segment of such a chain may differ in one bit at most, which is asked first and drops almost every candidate; only
what is left has its whole Hamming distance taken.

Equal fingerprints are one node. Candidates of a key are compared offset by offset, and only a spanning forest of their
links leaves the task. A key with more than `HOT` different fingerprints is not compared at all: every fingerprint of it
names the places at one bit's distance from itself, and two that are two bits apart name one in common; that is linear
and exact, so no group is too large and no link is lost.

Nulls: a null text has no words and the fingerprint zero, as has an empty one; both link like any other. A null doc_id
is a row as any other and never the smallest of its component unless it is alone. Equal rows have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_texts, identified, known, light, masked, mix64, parts, utf8, windows, written
from .components import components, thinned

HOT = 1024
LIMIT, SEGMENTS = 2, 4
WIDTH = 64 // SEGMENTS
PAIRS = list(combinations(range(SEGMENTS), 2))
SLICE = 1 << 16  # shingles that are hashed and counted at a time
BIT = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each run of `size` words, joined by spaces; of all words, if they are fewer."""
    digest = xxhash.xxh64_intdigest
    if not words:
        return
    if len(words) < size:
        yield np.array([digest(b" ".join(words), seed)], np.uint64)
        return
    for i in range(0, len(words) - size + 1, SLICE):
        part = words[i : i + SLICE + size - 1]
        yield np.array([digest(b" ".join(s), seed) for s in zip(*(part[k:] for k in range(size)), strict=False)], np.uint64)


def fingerprint(words: list[bytes], size: int) -> int:
    counts, total = np.zeros((8, 256), np.int64), 0
    for h in shingle_hashes(words, size):
        total += len(h)
        for k in range(8):
            counts[k] += np.bincount((h >> np.uint64(8 * k)).astype(np.uint8), minlength=256)
    ones = (counts @ BIT).ravel()
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column("text"))
            data = buf.tobytes()
            fps = [fingerprint(data[a:b].lower().split(), size) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def segment(i: int) -> int:
    """The bits of segment i of the ring."""
    return ((1 << WIDTH) - 1) << WIDTH * (i % SEGMENTS)


def chains(pair: tuple[int, int]) -> list[int]:
    """For two equal segments, the bits of the third one of each chain of three that starts with an equal segment."""
    return [segment(3 * s + 3 - pair[0] - pair[1]) for s in pair if set(pair) <= {(s + k) % SEGMENTS for k in range(3)}]


#: For each pair of segments two such masks; the same twice where there is one chain.
THIRD = np.array([(chains(p) * 2)[:2] for p in PAIRS], np.uint64)


def chained(x: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Whether differences x of fingerprints that agree in a pair of segments have a chain of three within its share."""
    share = LIMIT * 3 // SEGMENTS
    return (np.bitwise_count(x & THIRD[pair, 0]) <= share) | (np.bitwise_count(x & THIRD[pair, 1]) <= share)


def near(fp: np.ndarray, pair: np.ndarray, left: np.ndarray, seen: list[tuple[int, int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that are grouped by key; left: how many rows of its key follow each. seen: gets the numbers of
    candidates, of those that the chains leave, and of links."""
    found, at, d = [np.zeros((2, 0), np.int64)], np.flatnonzero(left), 1
    while len(at):
        x = fp[at] ^ fp[at + d]
        keep = np.flatnonzero(chained(x, pair[at]))
        hit = at[keep][np.bitwise_count(x[keep]) <= LIMIT]
        found.append(np.stack((hit, hit + d)))
        if seen is not None:
            seen.append((len(at), len(keep), len(hit)))
        d += 1
        at = at[left[at] >= d]
    a, b = np.concatenate(found, axis=1)
    return a, b


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """fps: different fp. Links a, b that connect what links of at most `limit` bits connect."""
    if limit != LIMIT:
        raise ValueError(f"keys, chains and places are those of {LIMIT} bits")

    def masked(i: int, j: int) -> int:
        m = segment(i) | segment(j)
        return m - (1 << 64) if m >= 1 << 63 else m

    fps = known(fps)
    keys = F.array(*[F.struct(F.lit(k).alias("pair"), F.col("fp").bitwiseAND(F.lit(masked(i, j))).alias("key")) for k, (i, j) in enumerate(PAIRS)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.pair", "k.key")
    hot = keyed.groupBy("pair", "key").count().where(F.col("count") > HOT).select("pair", "key")
    buckets = parts(fps, 1 << 20)  # six keys for each
    cold = keyed.join(hot, ["pair", "key"], "left_anti")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pa.Table.from_batches(held)
        fp, pair, key = (t.column(c).to_numpy() for c in ("fp", "pair", "key"))
        order = np.lexsort((fp, key, pair))
        fp, pair, key = fp[order], pair[order], key[order]
        at = np.append(np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (key[1:] != key[:-1])))), len(fp))
        size = np.diff(at)
        a, b = near(fp.view(np.uint64), pair, np.repeat(at[1:], size) - np.arange(len(fp)) - 1)
        a, b = thinned(fp[a], fp[b])
        yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    near_links = cold.repartition(buckets, "pair", "key").mapInArrow(compare, "a bigint, b bigint")
    free = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)])
    places = F.concat(F.array(F.col("fp")), F.transform(free, lambda m: F.col("fp").bitwiseXOR(m)))
    balls = keyed.join(hot, ["pair", "key"]).select("fp").distinct().select("fp", F.explode(places).alias("place"))
    least = balls.groupBy("place").agg(F.min("fp").alias("b"))
    hot_links = balls.join(least, "place").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    return near_links.unionByName(hot_links)


def linked(docs: DataFrame, size: int = 3, limit: int = LIMIT) -> DataFrame:
    """doc_id, fp, component_id."""
    marks = written(fingerprints(docs, size), "simhash")
    nodes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash")
    roots = components(links(nodes.select("fp"), limit))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp", "left").select("doc_id", "fp", "component_id")


# --- groups of near copies, for a filter -------------------------------------------------------------------------------
#
# Two documents are linked if the sets of their five-word shingles have a similarity (Jaccard) of 0.8 or more, and it is
# the sets that decide. Links are looked for twice.
#
# First by fingerprints of 512 bits of the sets, on a ring of 32 segments. Sets that are equal in a segment meet under it,
# and stay if each chain from there on, of two to five segments, has no more than its share of `WIDE` differences, three a
# segment; what is left has its whole Hamming distance taken, and then its sets compared. Each of a key's rows goes on with
# the nearest row before it, and in a key of more than `HOT` rows only neighbours in the order of the next segments are
# compared. Two that differ in up to 31 bits have a key whose chains they pass; 0.8 is up to 105 bits, where only keys that
# hold a fifth of all pairs are complete, so this finds most links and not all.
#
# So then, exactly, whatever that has left apart. If every set is put in one order of all shingles, two sets of that
# similarity share a shingle among the first n - ceil(0.8 n) + 1 of each, and the first that they share leaves room for
# the overlap that 0.8 asks for. The order is by rarity, as far as a table of counts of fixed size tells it; any
# order is complete, this one makes few candidates. Of these only pairs in different components are compared.
#
# Equal sets are one node, named by 64 bits of their hash; shingles are 64-bit hashes. So results are whole but for
# collisions of these. A shingle of more than `RUN` nodes is first compared along its ring, and then only between
# components that this has left apart.

WORDS, RINGED, WIDE = 8, 32, 96  # words of 64 bits, segments and limit of these fingerprints
SEEDS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: The bits that follow a segment up to the end of a chain, and the chain's share of the limit.
SHARES = [((1 << 16 * k) - 1, WIDE * (k + 1) // RINGED) for k in range(1, 5)]
COUNTERS, BLOCKS, RUN, RING, SKETCH = 1 << 20, 16, 16, 8, 256
PARTITIONS = 8192  # of a shuffle
def node_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def wide_fingerprint(s: np.ndarray) -> np.ndarray:
    """512 bits of a set of hashes, as eight words: each is set if it is in more than half of the hashes mixed anew."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(s), 255):  # as many as a byte counts
        bits = np.unpackbits(mix64(s[i : i + 255, None] ^ SEEDS).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(s), bitorder="little").view("<u8")


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Of each text the hashes of all runs of `size` words, each once and sorted; of all words, if they are fewer."""
    buf, off = utf8(column)
    for h in hashed_texts(np.frombuffer(buf.tobytes().lower(), np.uint8), off):
        s = windows(h[:, 0], max(1, min(size, len(h))), 0xC2B2AE3D27D4EB4F)
        s.sort()
        yield s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def marked(docs: DataFrame, size: int) -> DataFrame:
    """One reading of all texts. For each document file, row, doc_id, node, fingerprint and how many of its shingles have
    each of SKETCH other hashes; and, as rows with a block, about how many documents of each task have a shingle, by its hash modulo
    COUNTERS."""
    each = COUNTERS // BLOCKS
    names = ["file", "row", "doc_id", "node", "fp", "sketch", "block", "counts"]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            nodes, fps, sketches = [], [], []
            for s in shingle_sets(batch.column("text"), size):
                nodes.append(node_of(s))
                fps.append(wide_fingerprint(s).view(np.int64))
                sketches.append(np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) & SKETCH - 1, minlength=SKETCH), 255).astype(np.uint8).tobytes())
                np.add.at(counts, s.astype(np.int64) & COUNTERS - 1, 1)
            own = [batch.column("__file"), batch.column("__row"), batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(fps, kinds[4]), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(nodes), k) for k in kinds[6:])], names)
        if counts.any():
            low = np.minimum(counts, 65535).astype(np.uint16).reshape(BLOCKS, each)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(BLOCKS, k) for k in kinds[:6]), pa.array(range(BLOCKS), pa.int32()), pa.array([r.tobytes() for r in low], pa.binary())], names)

    out = docs.select("__file", "__row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file bigint, row bigint, doc_id bigint, node bigint, fp array<bigint>, sketch binary, block int, counts binary")
    return written(out, "marked")


def nearest(key: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows are in the order of key and ahead, the 64 bits after an equal segment. For each row that has one, the row before
    it that is nearest of those whose chains stay within their shares."""
    at = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
    size = np.diff(at)
    left = np.repeat(at[1:], size) - np.arange(len(key)) - 1
    left = np.where(np.repeat(size, size) > HOT, np.minimum(left, RING), left)
    best, other = np.full(len(key), 65), np.full(len(key), -1)
    i, d = np.flatnonzero(left), 1
    while len(i):
        x = ahead[i] ^ ahead[i + d]
        k = np.arange(len(i))
        for bits, share in SHARES:
            k = k[np.bitwise_count(x[k] & np.uint64(bits)) <= share]
        far, j = np.bitwise_count(x[k]), i[k] + d
        nearer = far < best[j]
        best[j[nearer]], other[j[nearer]] = far[nearer], i[k][nearer]
        d += 1
        i = i[left[i] >= d]
    found = np.flatnonzero(other >= 0)
    return found, other[found]


def alike(nodes: DataFrame) -> DataFrame:
    """nodes: node, fp. Pairs a, b of nodes whose fingerprints meet in a segment, pass its chains and differ in at most
    `WIDE` bits."""
    buckets = parts(nodes, 1 << 20)
    row = np.dtype([("ahead", "<u8"), ("node", "<i8"), ("key", "<u4")])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            fp = batch.column("fp").flatten().to_numpy().view("<u2").reshape(-1, RINGED)
            rows = np.empty(fp.shape, row)
            rows["key"] = fp + (np.arange(RINGED, dtype=np.uint32) << 16)
            rows["node"] = batch.column("node").to_numpy()[:, None]
            rows["ahead"] = np.stack([np.roll(fp, -k, axis=1) for k in range(1, 5)], axis=2).view("<u8")[:, :, 0]
            rows = rows.ravel()
            bucket = (mix64(rows["key"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            at = np.append(np.flatnonzero(np.diff(bucket[by], prepend=-1)), len(by))
            packed = [rows[by[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[by[at[:-1]]], pa.int32()), "rows": pa.array(packed, pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(t.column("rows").to_pylist()), row)
        rows = rows[np.lexsort((rows["node"], rows["ahead"], rows["key"]))]
        a, b = nearest(rows["key"], rows["ahead"])
        pair = np.unique(np.sort(np.stack((rows["node"][a], rows["node"][b])), axis=0), axis=1)
        return pa.table({"a": pair[0], "b": pair[1]})

    dealt = nodes.select("node", "fp").mapInArrow(deal, "bucket int, rows binary")
    met = dealt.repartitionById(min(buckets, PARTITIONS), F.col("bucket")).groupBy("bucket").applyInArrow(meet, "a bigint, b bigint")
    pairs = written(met.distinct(), "met")
    with_a = pairs.join(nodes.select(F.col("node").alias("a"), F.col("fp").alias("x")), "a")
    both = with_a.join(nodes.select(F.col("node").alias("b"), F.col("fp").alias("y")), "b")
    far = sum((F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(WORDS)), F.lit(0))
    return both.where(far <= WIDE).select("a", "b")


def rarity(marks: DataFrame) -> np.ndarray:
    """The counters of all tasks together."""
    each = COUNTERS // BLOCKS

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(each, np.int64)
        for batch in batches:
            for c in batch.column("counts"):
                total += np.frombuffer(c.as_buffer(), np.uint16)
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    out = np.zeros((BLOCKS, each), np.uint32)
    for r in marks.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[r.block] = np.frombuffer(r.counts, np.uint32)
    return out.ravel()


def together(na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Whether sets of na and nb can be similar, if the first shingle they share is the pa_-th of one, the pb-th of the other."""
    return 9 * np.minimum(na - pa_, nb - pb) >= 4 * (na + nb)


def ring_pairs(n: np.ndarray, place: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one run that may be similar, those at distances of up to `most`."""
    for d in range(1, min(most, len(n) - 1) + 1):
        i = np.flatnonzero(together(n[:-d], n[d:], place[:-d], place[d:]))
        yield i + d, i


def candidates(docs: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    """a, b: pairs to compare, some of them often. Where b is null, a is a node of a run of over RUN, with key, n, place."""
    counts = docs.sparkSession.sparkContext.broadcast(rarity(marks))
    buckets = parts(docs, 1 << 20)
    row = np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<i4"), ("place", "<i4")])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, seen = [np.zeros(0, row)], set()
            for s in shingle_sets(batch.column("text"), size):
                node = node_of(s)
                if node in seen or not len(s):
                    continue
                seen.add(node)
                first = len(s) - -(-4 * len(s) // 5) + 1
                at = np.lexsort((s, counts.value[s.astype(np.int64) & COUNTERS - 1]))[:first]
                rows = np.empty(len(at), row)
                rows["key"], rows["node"], rows["n"], rows["place"] = s[at], node, len(s), np.arange(len(at))
                held.append(rows)
            rows = np.concatenate(held)
            bucket = (mix64(rows["key"]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            at = np.append(np.flatnonzero(np.diff(bucket[by], prepend=-1)), len(by))
            packed = [rows[by[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[by[at[:-1]]], pa.int32()), "rows": pa.array(packed, pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(t.column("rows").to_pylist()), row)
        rows = rows[np.lexsort((rows["node"], rows["key"]))]
        rows = rows[np.concatenate(([True], (rows["key"][1:] != rows["key"][:-1]) | (rows["node"][1:] != rows["node"][:-1])))]  # equal sets meet as one
        at = np.append(np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1]))), len(rows))
        size_ = np.diff(at)
        a, b, hot = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, row)]
        for s, e in zip(at[:-1][size_ > 1].tolist(), at[1:][size_ > 1].tolist(), strict=True):
            own = rows[s:e]
            for i, k in ring_pairs(own["n"], own["place"], RING if len(own) > RUN else RUN):
                a.append(own["node"][i])
                b.append(own["node"][k])
            if len(own) > RUN:
                hot.append(own)
        pair = np.unique(np.stack((np.concatenate(a), np.concatenate(b))), axis=1)
        own = np.concatenate(hot)
        none = pa.nulls(pair.shape[1], pa.int64())
        lists = ((pair[0], own["node"]), (pair[1], None), (None, own["key"].view(np.int64)), (None, own["n"]), (None, own["place"]))
        fill = lambda x, n: pa.nulls(n, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x).astype(np.int64))
        return pa.table({c: pa.chunked_array([fill(x, len(none)), fill(y, len(own))]) for c, (x, y) in zip(("a", "b", "key", "n", "place"), lists, strict=True)})

    dealt = docs.select("text").mapInArrow(deal, "bucket int, rows binary")
    return dealt.repartitionById(min(buckets, PARTITIONS), F.col("bucket")).groupBy("bucket").applyInArrow(meet, "a bigint, b bigint, key bigint, n bigint, place bigint")


def apart(hot: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: the pairs of each run that may be similar and are in different components.

    Whatever is outside a run's largest component is held against all of the run; only pairs go on whose sketches leave
    room for the overlap: no more shingles can be shared than the sum of the lesser counts."""
    placed = hot.join(roots, hot["a"] == roots["node"], "left").select("key", "a", "n", "place", F.coalesce("root", "a").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    left = placed.join(mixed, "key", "left_semi").join(nodes.select(F.col("node").alias("a"), "sketch"), "a")

    def cross(t: pa.Table) -> pa.Table:
        a, n, place, root = (t.column(c).to_numpy() for c in ("a", "n", "place", "root"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        names, which, often = np.unique(root, return_inverse=True, return_counts=True)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(which != often.argmax()).tolist():
            k = np.flatnonzero((root != root[i]) & together(n[i], n, place[i], place))
            most = np.minimum(sketch[k], sketch[i]).sum(axis=1)
            # A count that did not fit has no bound.
            most[(sketch[k] == 255).any(axis=1) | (sketch[i] == 255).any()] = 1 << 30
            k = k[9 * most >= 4 * (n[i] + n[k])]
            out_a.append(np.full(len(k), a[i]))
            out_b.append(a[k])
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return left.groupBy("key").applyInArrow(cross, "a bigint, b bigint")


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """pairs: a, b. Those whose sets of shingles have a similarity of 0.8 or more, by the texts of the nodes' first rows."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    # Written, so that Spark knows its size before it chooses how to join it.
    wanted = written(wanted.select("node", F.col("first.file").alias("__file"), F.col("first.row").alias("__row")), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "shingles": pa.array(found, pa.binary())})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort()
                keep.append(9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = written(docs.select("__file", "__row", "text").join(light(wanted), ["__file", "__row"]).select("node", "text").mapInArrow(sets, "node bigint, shingles binary"), "sets")
    with_a = pairs.join(own.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.join(own.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(verify, "a bigint, b bigint"), "similar")


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs: a, b. Those whose ends are in different components."""
    for c in ("a", "b"):
        own = roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        pairs = pairs.join(own, c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    return pairs.where("root_a != root_b").select("a", "b")


def one_of_each(docs: DataFrame, size: int = 5) -> DataFrame:
    """docs without near copies: of each group the row with the smallest doc_id stays."""
    own = masked(docs, "doc_id", "text")
    named = identified(own)
    marks = marked(named, size)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "file", "row"))
    each = [F.any_value(c).alias(c) for c in ("fp", "sketch")]
    nodes = written(marks.where("block is null").groupBy("node").agg(first.alias("first"), *each), "nodes")
    links = similar(alike(nodes), nodes, named, size)
    roots = written(components(links), "roots")
    found = written(candidates(named, marks, size), "candidates")
    links = links.unionByName(similar(between(found.where("b is not null").select("a", "b"), roots), nodes, named, size))
    roots = components(links)
    hot = found.where("b is null").select("a", "key", "n", "place")
    if not hot.isEmpty():
        roots = components(links.unionByName(similar(apart(hot, roots, nodes), nodes, named, size)))
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.file", "first.row")
    # The rows that go are fewer than those that stay, and have no texts.
    gone = marks.where("block is null").select("file", "row").join(kept, ["file", "row"], "left_anti")
    gone = written(gone.select(F.col("file").alias("__file"), F.col("row").alias("__row")), "gone")
    return named.join(light(gone), ["__file", "__row"], "left_anti").select(*own.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
