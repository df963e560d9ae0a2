"""Benchmark decontamination: prefix-filtered containment of item-sized windows.

A window is 10 consecutive words of an item (all of a shorter item). Its shingles are its runs of three words (the
whole of a window of fewer), ordered by rarity, which is counted over all documents. For containment of 1 the prefix
that must be joined is one shingle, the window's rarest: a document holds the window only where it holds that one.

Documents are read twice, whatever the number of items: once to count shingles of items, once to find their prefixes.
Both times a filter of hashes, of a fixed size at most, is sent to all executors and only says which shingles may be
wanted; texts stay where they are. A possible place goes on with the few words about it, and an ordinary join, which
Spark broadcasts, shuffles or splits as sizes tell it, finds the windows of its shingle. The bounds: the shingle's place
in the window must leave the window within the text. What is left is compared word by word.

Nulls: a null text has no words. Items without words match nothing; a null item_id is named by the empty string;
rows of one item_id count as one item. Null doc_ids and repeated rows keep their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_texts, identified, input_bytes, masked, utf8, windows, written

WINDOW, SHINGLE = 10, 3
FEW_BITS, FILTER_BITS = 24, 27  # of the smallest and the largest filter, as powers of two: 2 and 16 MB
BLOCKS = 16
STEP = 0xC2B2AE3D27D4EB4F
#: Lower-cases A-Z; ASCII but letters and digits becomes space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def texts(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each text, its words apart by spaces, and the hashes of its words."""
    buf, off = utf8(column)
    data = buf.tobytes().translate(TABLE)
    for a, b, hashes in zip(off[:-1].tolist(), off[1:].tolist(), hashed_texts(np.frombuffer(data, np.uint8), off), strict=True):
        yield data[a:b], hashes


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    return windows(hashes[:, 0], size, STEP)


# --- items ----------------------------------------------------------------------------------------------------------


def item_windows(bench: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """words, items, m, s and shingles of each different window: its words, the items that hold it, the numbers of words
    in it and in its shingles, and their hashes in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, (text, own) in zip(batch.column("item").to_pylist(), texts(batch.column("text")), strict=True):
                w = text.split()
                starts = range(max(1, len(w) - size + 1) if w else 0)
                found = [w[k : k + size] for k in starts]
                hashes = [shingles(own[k : k + size], min(shingle, len(w))).view(np.int64) for k in starts]
                yield pa.RecordBatch.from_pydict({"words": pa.array(found, pa.list_(pa.binary())), "item": pa.array([name] * len(found), pa.string()), "shingles": pa.array(hashes, pa.list_(pa.int64()))})

    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    cut_up = items.mapInArrow(cut, "words array<binary>, item string, shingles array<bigint>")
    own = cut_up.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"), F.first("shingles").alias("shingles"))
    return written(own.select("words", "items", "shingles", F.size("words").alias("m"), F.least(F.size("words"), F.lit(shingle)).alias("s")), "windows")


class Filter:
    """Bits of hashes: which shingles may be wanted."""

    def __init__(self, power: int, data: np.ndarray):
        self.shift, self.data = np.uint64(64 - power), data

    @classmethod
    def of(cls, hashes: DataFrame) -> Filter:
        """hashes: h. About 16 bits for each, as far as `FILTER_BITS` allows; the driver gets no more than these bits."""
        power = max(10, min(FILTER_BITS, max(FEW_BITS, (2 * input_bytes(hashes)).bit_length())))
        each = (1 << power) // 8 // BLOCKS

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(each * BLOCKS, np.uint8)
            for batch in batches:
                at = (batch.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - power)).astype(np.int64)
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            rows = [(k, r.tobytes()) for k, r in enumerate(bits.reshape(BLOCKS, each)) if r.any()]
            yield pa.RecordBatch.from_pydict({"block": pa.array([k for k, _ in rows], pa.int32()), "bits": pa.array([r for _, r in rows], pa.binary())})

        def either(t: pa.Table) -> pa.Table:
            bits = np.zeros(each, np.uint8)
            for r in t.column("bits"):
                bits |= np.frombuffer(r.as_py(), np.uint8)
            return pa.table({"block": t.column("block")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

        data = np.zeros((BLOCKS, each), np.uint8)
        schema = "block int, bits binary"
        for r in hashes.mapInArrow(mark, schema).groupBy("block").applyInArrow(either, schema).collect():
            data[r.block] = np.frombuffer(r.bits, np.uint8)
        return cls(power, data.ravel())

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        return self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


# --- documents ------------------------------------------------------------------------------------------------------


def rarity(docs: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """h, n: how often shingles that may be items' are found in all texts. wanted: h, of items."""
    sent = docs.sparkSession.sparkContext.broadcast(Filter.of(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, hashes in texts(batch.column("text")):
                for s in sizes:
                    h = shingles(hashes, s)
                    found.append(h[sent.value.has(h)])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "n": n.astype(np.int64)})

    return docs.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def prefixes(docs: DataFrame, bench: DataFrame) -> tuple[DataFrame, list[int]]:
    """h, place, m, words and items of each window, by its rarest shingle; the numbers of words in shingles."""
    own = item_windows(bench)
    sizes = sorted(r.s for r in own.select("s").distinct().collect())  # three at most
    each = own.select("words", F.posexplode("shingles").alias("place", "h"))
    often = rarity(docs, own.select(F.explode("shingles").alias("h")), sizes)
    rarest = each.join(often, "h", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "h", "place")).alias("r"))
    return written(rarest.join(own, "words").select("r.h", "r.place", "m", "words", "items"), "prefixes"), sizes


def candidates(docs: DataFrame, index: DataFrame, sizes: list[int], carry: tuple[str, ...]) -> DataFrame:
    """carry, n_words and places of each document: shingles that may be prefixes, and the words about them."""
    sent = docs.sparkSession.sparkContext.broadcast(Filter.of(index.select("h")))
    place = pa.struct([("h", pa.int64()), ("start", pa.int32()), ("at", pa.int32()), ("near", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, places = [], []
            for text, hashes in texts(batch.column("text")):
                counts.append(len(hashes))
                w, own = [], []
                for s in sizes:
                    h = shingles(hashes, s)
                    for i in np.flatnonzero(sent.value.has(h)).tolist():
                        w = w or text.split()
                        a = max(0, i - WINDOW + 1)
                        own.append({"h": int(h[i : i + 1].view(np.int64)[0]), "start": a, "at": i - a, "near": w[a : i + WINDOW]})
                places.append(own)
            kept = [batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(places, pa.list_(place))], [*carry, "n_words", "places"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in carry) + ", n_words bigint, places array<struct<h: bigint, start: int, at: int, near: array<binary>>>"
    return docs.select(*carry, "text").mapInArrow(run, schema)


def verified(found: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """key, start, m, items: windows that documents hold. found: key and p, a place."""
    fits = (F.col("p.at") >= F.col("place")) & (F.col("p.at") - F.col("place") + F.col("m") <= F.size("p.near"))
    exact = F.slice("p.near", F.col("p.at") - F.col("place") + 1, F.col("m")) == F.col("words")
    both = found.join(index, found["p.h"] == index["h"]).where(fits & exact)
    return both.select(key, (F.col("p.start") + F.col("p.at") - F.col("place")).alias("start"), "m", "items")


def union_length(spans: Column) -> Column:
    """The number of words in the union of spans, which are sorted structs of start and m."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    end = lambda x: x["start"] + x["m"]
    more = lambda a, x: F.greatest(F.lit(0), end(x) - F.greatest(a["end"], x["start"]))
    return F.aggregate(spans, begin, lambda a, x: F.struct(F.greatest(a["end"], end(x)).alias("end"), (a["n"] + more(a, x)).alias("n")), lambda a: a["n"])


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index, sizes = prefixes(slim, bench)
    base = written(candidates(slim, index, sizes, ("doc_id",)).withColumn("uid", F.monotonically_increasing_id()), "places")
    none, some = base.where("size(places) = 0"), base.where("size(places) > 0")
    hits = verified(some.select("uid", F.explode("places").alias("p")), index, "uid")
    by_doc = hits.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("start", "m"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    both = some.select("uid", "doc_id", "n_words").join(by_doc, "uid", "left")
    shown = lambda df, hit, n, names: df.select("doc_id", "n_words", hit.alias("n_hit"), n.cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
    zero = F.lit(0).cast("long")
    hit = F.coalesce(union_length(F.col("spans")), zero)
    return shown(none, zero, zero, F.lit("")).unionByName(shown(both, hit, F.greatest(F.coalesce(F.size("items"), zero), zero), F.coalesce(F.array_join("items", ","), F.lit(""))))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of any item."""
    own = masked(docs, "doc_id", "text")
    named = identified(own)
    index, sizes = prefixes(named, bench)
    found = candidates(named, index, sizes, ("__file", "__row")).where("size(places) > 0")
    found = written(found.select(F.struct("__file", "__row").alias("id"), F.explode("places").alias("p")), "places")
    # Written, so that Spark knows its size before it chooses how to join it.
    gone = written(verified(found, index, "id").select("id.*").distinct(), "gone")
    return named.join(gone, ["__file", "__row"], "left_anti").select(*own.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(words, i, i + 9) AS win FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT len(win) AS m FROM bw),
dw AS (SELECT doc_id, i, m, list_slice(words, i, i + m - 1) AS win FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM d, sizes WHERE len(words) >= m)),
h AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.win = bw.win),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
