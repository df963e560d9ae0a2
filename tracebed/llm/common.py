"""What the operators share: the shared scratch folder, written steps, UTF-8 buffers, words and their hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
NULL_ID = np.iinfo(np.int64).max  # a null doc_id ranks after all others
#: How a step is run. Its shuffle files go when it ends, so that steps of one operator do not add up on disk; texts go to
#: Python a few MB at a time, as workers and the buffers that feed them are many.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, whose executors are the
    driver, may leave it unset and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracebed-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders that this process has made, in the order in which it made them.
MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    MADE.append(f"{shared_dir(spark)}/tracebed/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch folders that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in MADE:
            MADE.remove(path)


def clear(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the scratch folders that were made after the first `since`. Frames that read them are void."""
    drop(spark, *[p for p in MADE[since:] if p not in keep])


def written(df: DataFrame, name: str, supersedes: DataFrame | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lost executors cost no recomputation behind it.

    supersedes: a frame that `written` returned, which nothing but df reads; its table goes."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    if supersedes is not None:
        drop(spark, supersedes._table)
    return out


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df; it grows with the files that are read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def known(df: DataFrame) -> DataFrame:
    """df, or a written copy if Catalyst cannot tell its size (data from the driver or an RDD, say)."""
    return df if input_bytes(df) < 1 << 50 else written(df, "input")


def parts(df: DataFrame, each: int, least: int = 8) -> int:
    """How many pieces of about `each` bytes df makes."""
    return max(least, -(-input_bytes(df) // each))


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one buffer and its len + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    wide = column.cast(pa.large_binary()) if column.null_count == 0 else pa.array([x or b"" for x in column.cast(pa.large_binary()).to_pylist()], pa.large_binary())
    if len(wide) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = wide.buffers()
    off = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def ids(column: pa.ChunkedArray) -> np.ndarray:
    """doc_id as int64, null as NULL_ID."""
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(off: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive documents of at most `most` bytes together; a longer document is a range of its own."""
    out, i = [], 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        out.append((i, j))
        i = j
    return out


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
REST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of texts in one buffer."""
    space = SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    start = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | first[:-1]))
    end = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | first[1:])) + 1
    return start, end


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each word, as rows: eight bytes after the other are absorbed and mixed, so words of any length
    differ but by chance; no sum or polynomial of their characters."""
    eight = np.ndarray(len(buf), "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
    size = end - start
    one = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    two = one ^ np.uint64(0xC2B2AE3D27D4EB4F)
    at = np.arange(len(size))
    for k in range(0, int(size.max(initial=0)), 8):
        at = at[size[at] > k]
        part = eight[start[at] + k] & REST[np.minimum(size[at] - k, 8)]
        one[at] = h = mix64(one[at] ^ part)
        two[at] = mix64((two[at] + part) * np.uint64(0xD6E8FEB86659FD93) ^ h >> np.uint64(32))
    return np.stack((one, two), axis=1)


def hashed_texts(buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The word_hashes of each text, derived some 256 KB of texts at a time."""
    for i, j in slices(off, 1 << 18):
        b, own = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        start, end = word_spans(b, own)
        hashes = word_hashes(b, start, end)
        yield from np.split(hashes, np.searchsorted(start, own[1:-1]))


def windows(hashes: np.ndarray, k: int, step: int) -> np.ndarray:
    """The hash of each run of k words, from a column of word hashes: no polynomial of characters, so runs collide by
    chance alone."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(step) + hashes[j : j + n]
    return mix64(out)


def identified(docs: DataFrame) -> DataFrame:
    """docs with __file and __row, which name a row of a stored table whatever reads it and however it is split."""
    names = lambda df: df.select("*", F.xxhash64(df.metadataColumn("_metadata")["file_path"]).alias("__file"), df.metadataColumn("_metadata")["row_index"].alias("__row"))
    try:
        return names(docs)
    except AnalysisException:  # not a plain scan of files
        return names(written(docs, "input"))


def masked(docs: DataFrame, *keep: str) -> DataFrame:
    """docs with other names for all columns but these, so that none clashes with what an operator adds."""
    return docs.toDF(*[c if c in keep else f"__c{i}" for i, c in enumerate(docs.columns)])


def light(table: DataFrame, row_bytes: int = 24, most: int = 16 << 20) -> DataFrame:
    """A written table, with a broadcast hint if it is small by the count in its files; else Spark chooses how to join it."""
    return F.broadcast(table) if table.count() * row_bytes <= most else table
