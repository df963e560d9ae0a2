"""Aggregations over messages, rendered text and extents."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FILE_ORDER, KEY
from .render import with_dictionary


def argument(i: int, kind: str) -> Column:
    """Argument i of a message, from 0, as a kind of values: i, u, d, s or b; null if there is none of it."""
    return F.get("args", F.lit(i))[kind]


def num_args() -> Column:
    return F.size("args")


def first_integer(compat: bool = False) -> Column:
    """The first argument if it is an integer; compat: its low 32 bits, signed."""
    value = F.coalesce(F.get("args", F.lit(0))["i"], F.get("args", F.lit(0))["u"].cast("long"))
    return wrap32(value) if compat else value


def wrap32(value: Column) -> Column:
    low = value.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def totals(matching: Column, value: Column) -> list[Column]:
    own = F.when(matching, value)
    count = F.count_if(matching)
    return [
        F.count("*").alias("num_logs"),
        count.alias("matching"),
        F.min(own).cast("long").alias("min"),
        F.max(own).cast("long").alias("max"),
        F.sum(own).cast("long").alias("total"),
    ]


def min_max_mean(events: DataFrame, log_id: int, value: Column | None = None, compat: bool = False) -> DataFrame:
    """One row over all executions; the mean is a whole number, cut towards zero, and null without a match. compat: only
    the low 32 bits of an argument count, as a signed number."""
    value = first_integer(compat) if value is None else value
    df = events.agg(*totals(F.col("log_id") == log_id, value.cast("long")))
    return df.select("*", F.expr("total div nullif(matching, 0)").alias("mean"), (100.0 * F.col("matching") / F.expr("nullif(num_logs, 0)")).alias("pct"))


def min_max_mean_by_statement(events: DataFrame, dictionary: DataFrame, log_id: int, compat: bool = False) -> DataFrame:
    """The same for each statement that executions give the id to: ids begin anew with every checkpoint."""
    own = dictionary.where(F.col("log_id") == log_id).select(*KEY, "filename", "line", "fmt")
    df = with_dictionary(events.where(F.col("log_id") == log_id), own).groupBy("filename", "line", "fmt").agg(*totals(F.lit(True), first_integer(compat).cast("long")))
    return df.select("filename", "line", "fmt", "matching", "min", "max", "total", F.expr("total div nullif(matching, 0)").alias("mean"))


def count_by_id(events: DataFrame) -> DataFrame:
    return events.groupBy("log_id").agg(F.count("*").alias("n"))


def aggregate_with(events: DataFrame, log_id: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's aggregate over the messages of one id, an execution at a time."""
    return events.where(F.col("log_id") == log_id).groupBy("file", "execution_id").applyInPandas(fn, schema)


def number_at_start(text: Column) -> Column:
    """The whole number that a text begins with, after white space; 0 without one."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0))


def text_totals(lines: DataFrame, needle: str, line: str = "line_text") -> DataFrame:
    """min, max, mean, total and count of the numbers after the needle, over lines that contain it."""
    at = F.locate(needle, F.col(line)) + len(needle)
    df = lines.where(F.contains(F.col(line), F.lit(needle))).select(number_at_start(F.substr(line, at)).alias("v"))
    return df.agg(F.min("v").alias("min"), F.max("v").alias("max"), F.expr("sum(v) div nullif(count(v), 0)").alias("mean"), F.sum("v").alias("total"), F.count("v").alias("matching"))


def regex_totals(lines: DataFrame, pattern: str = r"^.*# (\d+)", line: str = "line_text") -> DataFrame:
    df = lines.where(F.col(line).rlike(pattern)).select(F.regexp_extract(line, pattern, 1).cast("long").alias("v"))
    return df.agg(F.min("v").alias("min"), F.max("v").alias("max"), F.expr("sum(v) div nullif(count(v), 0)").alias("mean"), F.sum("v").alias("total"), F.count("v").alias("matching"))


def field_mean(lines: DataFrame, needle: str, field: int, line: str = "line_text") -> DataFrame:
    """The mean, as a float, of a field of white-space separated lines that contain the needle."""
    v = F.get(F.split(F.trim(F.col(line)), r"\s+"), F.lit(field - 1)).try_cast("double")
    return lines.where(F.contains(F.col(line), F.lit(needle))).select(v.alias("v")).agg(F.avg("v").alias("mean"), F.count("v").alias("matching"))


def extents(events: DataFrame, size: Column) -> DataFrame:
    """Messages and bytes of each extent."""
    keys = [*FILE_ORDER[:3], "stage_id", "thread_id"]
    return events.groupBy(*keys).agg(F.count("*").alias("messages"), F.sum(size).cast("long").alias("bytes"))


def counters(events: DataFrame) -> DataFrame:
    """Messages, extents and checkpoints read."""
    return events.agg(F.count("*").alias("messages"), F.countDistinct("execution_id", "extent_id").alias("extents"), F.countDistinct("execution_id").alias("executions"))


def histogram(df: DataFrame, bin_: Column, bins: int = 20) -> DataFrame:
    """Counts of bins 0 .. bins - 1, empty ones too; values beyond fall into the last."""
    own = df.groupBy(F.least(bin_.cast("int"), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(own, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def size_histogram(extents: DataFrame, capacity: int = 1 << 20, bins: int = 20) -> DataFrame:
    """How full buffers of `capacity` bytes were when they were drained."""
    return histogram(extents, F.floor(bins * F.col("bytes") / capacity), bins)


def wait_histogram(waits: DataFrame, width: float = 10, bins: int = 20) -> DataFrame:
    """Waits (a column of nanoseconds) by bins of `width`; the last has all longer ones."""
    return histogram(waits, F.floor(F.col("wait") / width), bins)


def by_thread(events: DataFrame, size: Column, wait: Column | None = None) -> DataFrame:
    """Messages and bytes of each thread; with its waits how often it was blocked, and for how long."""
    more = [] if wait is None else [F.count_if(wait > 0).alias("blocked"), F.sum(wait).cast("long").alias("blocked_ns")]
    return events.groupBy("thread_id").agg(F.count("*").alias("messages"), F.sum(size).cast("long").alias("bytes"), *more)


#: Bytes of a message before it is packed: its head, and numbers as wide as their types (fixed by the file format).
HEAD_BYTES, WIDTHS = 16, {"signed_char_t": 1, "unsigned_char_t": 1, "short_int_t": 2, "unsigned_short_int_t": 2, "int_t": 4, "unsigned_int_t": 4, "wint_t_t": 4, "long_double_t": 16}


def entry_bytes() -> Column:
    """The size of a message as it was recorded."""
    table = F.create_map(*[F.lit(x) for pair in WIDTHS.items() for x in pair])
    text = lambda a: F.coalesce(F.octet_length(a["b"]), F.octet_length(a["s"]))
    wide = lambda a: F.length(a["s"]) * F.when(a["type"] == "const_wchar_t_ptr_t", 4)
    dynamic = lambda a: F.when(a["width"].isNotNull(), 4).otherwise(0) + F.when(a["prec"].isNotNull(), 4).otherwise(0)
    one = lambda a: dynamic(a) + F.coalesce(wide(a) + 4, text(a) + 4, F.element_at(table, a["type"]), F.lit(8))
    return HEAD_BYTES + F.aggregate("args", F.lit(0), lambda n, a: n + one(a))


def statistics(events: DataFrame, extents: DataFrame, seconds: float | None = None, page: int = 512) -> DataFrame:
    """One row: events, bytes recorded and written, padding to whole pages, the range of compression without and with it,
    bytes for each event; and, where the seconds are known, rates."""
    read = events.agg(F.count("*").alias("events"), F.coalesce(F.sum(entry_bytes()), F.lit(0)).cast("long").alias("bytes_in"))
    files = extents.groupBy("file").agg(F.sum("bytes").alias("bytes"))
    wrote = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes_out"), F.coalesce(F.sum(F.pmod(-F.col("bytes"), F.lit(page))), F.lit(0)).cast("long").alias("pad_bytes"))
    share = lambda a, b: F.try_divide(a.cast("double"), b)
    out = read.crossJoin(wrote).select(  # of one row each
        "events",
        "bytes_in",
        "bytes_out",
        "pad_bytes",
        share(F.col("bytes_in"), F.col("bytes_out") + F.col("pad_bytes")).alias("ratio_padded"),
        share(F.col("bytes_in"), F.col("bytes_out")).alias("ratio"),
        share(F.col("bytes_out"), F.col("events")).alias("bytes_per_event"),
    )
    if seconds is None:
        return out
    s = F.lit(float(seconds))
    return out.withColumns({"mb_per_second": share(F.col("bytes_out") / 1e6, s), "ns_per_byte": share(s * 1e9, F.col("bytes_out")), "ns_per_event": share(s * 1e9, F.col("events"))})
