"""Rendering: messages with their dictionary and clock, as text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import rendered_time, wall_clock
from ..functions.columnar import rendered
from ..schema import KEY, LEVELS, TIME_ORDER

# Fixed values of the text output.
END, MARKER = "\r\n", "\r\n# New execution started\r\n"
FOOTER = "\r\n\r\n# Decompression Complete after printing {} log messages\r\n"

DICTIONARY_LIMIT = 64 << 20  # bytes of dictionary that are broadcast; a larger one is joined by shuffle
PLAIN = r"%(?:[du]|l[du]|ll[du]|hh?[du]|[jzt][du]|s|i|l?i)"


def small(df: DataFrame, limit: int = DICTIONARY_LIMIT) -> DataFrame:
    """df with a broadcast hint if Catalyst knows it to be small; else AQE decides by what it measures."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def with_dictionary(events: DataFrame, dictionary: DataFrame, how: str = "inner") -> DataFrame:
    """Each message with its statement; left_anti gives messages that have none."""
    return events.join(small(dictionary), list(KEY), how)


def with_clock(events: DataFrame, executions: DataFrame) -> DataFrame:
    """Adds epoch_seconds and nanos by the clock of the message's execution."""
    both = events.join(small(executions.select("file", "execution_id", "ckpt_rdtsc", "unix_time", "cycles_per_second")), ["file", "execution_id"])
    seconds, nanos = wall_clock(F.col("rdtsc"), F.col("ckpt_rdtsc"), F.col("unix_time"), F.col("cycles_per_second"))
    return both.withColumn("epoch_seconds", seconds).withColumn("nanos", nanos)


def level_name(severity: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), (severity + 1).cast("int"))


def plain(dictionary: DataFrame) -> DataFrame:
    """Adds `plain`: whether all specifiers are bare integers and strings, which need no C; and the texts around them."""
    bare = F.regexp_replace(F.regexp_replace("fmt", PLAIN, ""), "%%", "")
    return dictionary.withColumn("plain", ~F.contains(bare, F.lit("%")) & ~F.contains(F.col("fmt"), F.lit("\\")) & ~F.contains(F.col("fmt"), F.lit("%%"))).withColumn("texts", F.split("fmt", PLAIN, -1))


def message(events: DataFrame, dictionary: DataFrame, unknown: str = "null") -> DataFrame:
    """Adds `message`. Bare formats are put together by built-in functions; others go, in Arrow batches, through C's rules.

    Messages whose statement is not in the dictionary, or has a format that is none, keep their row; unknown: "null" (the
    message is null) or "fail"."""
    if unknown not in ("null", "fail"):
        raise ValueError(f"unknown is null or fail, not {unknown}")
    d = plain(dictionary)
    shown = lambda a: F.coalesce(a["s"], a["i"].cast("string"), a["u"].cast("string"), F.lit(""))
    both = with_dictionary(events, d, "left")
    if unknown == "fail":
        both = both.withColumn("plain", F.when(F.col("valid"), F.col("plain")).otherwise(F.raise_error(F.concat(F.lit("No statement for message "), F.col("log_id").cast("string")))))
    native = F.concat(F.element_at("texts", 1), F.array_join(F.zip_with("args", F.slice("texts", F.lit(2), F.greatest(F.size("texts") - 1, F.lit(0))), lambda a, t: F.concat(shown(a), t)), ""))
    bare = F.coalesce("plain", F.lit(True)) | ~F.coalesce("valid", F.lit(False))
    easy = both.where(bare).withColumn("message", F.when(F.col("valid"), native)).drop("texts", "plain")
    if d.where("valid and not plain").isEmpty():  # the dictionary is looked at, never the events
        return easy
    hard = both.where(~bare).drop("texts", "plain")

    @F.arrow_udf("string")
    def run(fmt: pa.Array, args: pa.Array) -> pa.Array:  # only these go to Python
        return rendered(fmt, args)

    return easy.unionByName(hard.withColumn("message", run("fmt", "args")))


def lines(events: DataFrame, dictionary: DataFrame, executions: DataFrame, unknown: str = "null") -> DataFrame:
    """Adds `line_text`: time, place, level and thread before the message; null as the message is."""
    df = with_clock(message(events, dictionary, unknown), executions)
    prefix = F.format_string(" %s:%d %s[%d]: ", "filename", "line", level_name(F.col("severity")), "thread_id")
    return df.withColumn("line_text", F.concat(rendered_time(F.col("epoch_seconds"), F.col("nanos")), prefix, F.col("message")))


def text_lines(ordered: DataFrame) -> Iterator[str]:
    """The text output of an ordered frame of lines: markers between executions, and the footer."""
    n, seen = 0, None
    for row in ordered.select("file", "execution_id", "line_text").toLocalIterator():
        here = (row.file, row.execution_id)
        if seen is not None and here != seen:
            yield MARKER
        seen, n = here, n + 1
        yield f"{row.line_text}{END}"
    yield FOOTER.format(n)


def write_text(ordered: DataFrame, path: str) -> int:
    """The same as text files, written by executors in their order: a file for each partition, part numbers telling the
    order, and the footer as a file of its own behind them. Returns the number of messages.

    The marker of an execution stands before its first line, which the rows' own keys tell, not a neighbour's."""
    spark, order = ordered.sparkSession, F.struct(*[F.col(c) for c in TIME_ORDER if c in ordered.columns])
    firsts = ordered.groupBy("file", "execution_id").agg(F.min(order).alias("__first"))
    begin = firsts.agg(F.min(F.struct("file", "execution_id")).alias("b")).first()
    if begin is None or begin.b is None:
        footer(spark, path, 0)
        return 0
    marked = ordered.join(small(firsts), ["file", "execution_id"])
    new = (order == F.col("__first")) & ~((F.col("file") == begin.b.file) & (F.col("execution_id") == begin.b.execution_id))
    line = F.concat(F.when(new, MARKER).otherwise(""), F.coalesce("line_text", F.lit("None")), F.lit(END[:-1]))  # the writer ends lines
    marked.orderBy(*[c for c in TIME_ORDER if c in ordered.columns]).select(line.alias("value")).write.text(f"{path}/lines", lineSep=END[-1])
    n = ordered.count()
    footer(spark, path, n)
    return n


def footer(spark: SparkSession, path: str, n: int) -> None:
    spark.createDataFrame([(FOOTER.format(n)[:-1],)], "value string").coalesce(1).write.text(f"{path}/footer", lineSep=END[-1])
