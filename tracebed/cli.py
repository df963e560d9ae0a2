"""python -m tracebed.cli COMMAND LOG [ARGUMENT]: decompress, decompressUnordered, rcdfTime, minMaxMean, find."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregate, render, select, timing
from .sources.binlog import register

USAGE = """Usage: COMMAND LOG [ARGUMENT]
  decompress LOG            messages in order of time
  decompressUnordered LOG   messages in order of the file
  rcdfTime LOG              reverse distribution of the times between messages
  minMaxMean LOG ID [--int32]  statistics of the first argument of a message (its low 32 bits)
  find LOG TEXT             statements whose format contains the text
"""


def relations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    register(spark)
    read = lambda r: spark.read.format("binlog").option("relation", r).load(path)
    return read("events"), read("dictionary"), read("executions")


def decompress(spark: SparkSession, path: str, write: Callable[[str], object], ordered: bool = True) -> None:
    e, d, x = relations(spark, path)
    lines = render.lines(e, d, x, unknown="fail")
    for line in render.text_lines(select.in_time_order(lines, bounded=True, source=e) if ordered else select.in_file_order(lines)):
        write(line)


def find(spark: SparkSession, path: str, needle: str, write: Callable[[str], object]) -> None:
    write("%4s | %-20s | %-4s | %s\r\n" % ("id", "filename", "line", "format string"))
    for r in select.find(relations(spark, path)[1], needle).orderBy("log_id").toLocalIterator():
        write("%4d | %-20s | %-4d | %s\r\n" % (r.log_id, r.filename, r.line, r.fmt))


def min_max_mean(spark: SparkSession, path: str, log_id: str, write: Callable[[str], object], compat: bool = False) -> None:
    if not log_id.isdigit():
        raise ValueError(f"Invalid logId: {log_id}")
    e, d, _ = relations(spark, path)
    began = time.time()
    r = aggregate.min_max_mean(e, int(log_id), compat=compat).first()
    fmt = d.where(F.col("log_id") == int(log_id)).select("fmt").first()
    write(f'Aggregating log message "{fmt.fmt if fmt else ""}" (logId={log_id})\r\n')
    write(f"Logs Encountered: {r.num_logs}\r\nMatching Logs: {r.matching} ({r.pct or 0:.2f}%)\r\nMin: {r['min']}\r\nMax: {r['max']}\r\nMean: {r['mean']}\r\nTotal: {r.total}\r\n")
    write(f"# Took {time.time() - began:.2f} s\r\n")


def rcdf(spark: SparkSession, path: str, write: Callable[[str], object]) -> None:
    e, _, x = relations(spark, path)
    cps = x.agg(F.max("cycles_per_second")).first()[0] or 1e9
    d = timing.deltas(e, within=("file",))
    write("# Aggregating...\r\n")
    order = F.when(F.col("point") == "first", 0).when(F.col("point") == "inner", 1).otherwise(2)
    for r in timing.rcdf(d, cps).orderBy(order, "cycles").toLocalIterator():
        write("%8.2f    %11.10f\r\n" % (1e9 * r.cycles / cps, r.fraction))
    mean = timing.rcdf_mean(d).first().mean_cycles
    if mean is not None:
        write("# The mean was %0.2f ns\r\n" % (1e9 * mean / cps))


def time_trace(records: DataFrame, write: Callable[[str], object]) -> None:
    """records: as operators.timing.trace takes them, with a message column."""
    n = 0
    for r in timing.trace(records).orderBy("position").toLocalIterator():
        write("%8.1f ns (+%6.1f ns): %s\n" % (r.ns, r.delta_ns, r.message))
        n += 1
    if not n:
        write("No time trace events to print\n")


def main(args: list[str], spark: SparkSession | None = None, write: Callable[[str], object] = sys.stdout.write) -> int:
    needs = {"decompress": 2, "decompressUnordered": 2, "rcdfTime": 2, "minMaxMean": 3, "find": 3}
    if len(args) < 2 or needs.get(args[0], 99) > len(args):
        write(USAGE)
        return 1
    spark = spark or SparkSession.builder.appName("tracebed").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    command, path = args[:2]
    try:
        if command == "find":
            find(spark, path, args[2], write)
        elif command == "minMaxMean":
            min_max_mean(spark, path, args[2], write, "--int32" in args[3:])
        elif command == "rcdfTime":
            rcdf(spark, path, write)
        else:
            decompress(spark, path, write, command == "decompress")
    except ValueError as e:
        write(f"{e}\r\n")
        return 255
    except PySparkException as e:
        if "initial checkpoint" not in str(e) and "Unable to open" not in str(e):
            raise
        write(f"Could not read initial checkpoint\r\nUnable to open file {path}\r\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
