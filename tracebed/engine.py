"""The engine's switches: severity, log file, statistics, configuration, sync.

Levels and paths are settings of the session, so that they hold for its queries and are seen by all its users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .operators.aggregate import statistics
from .schema import DEBUG, LEVELS, NOTICE, SILENT
from .sources.binlog import register

LEVEL, FILE = "spark.tracebed.level", "spark.tracebed.file"


def set_log_level(spark: SparkSession, level: int) -> None:
    """Levels beyond the known ones become the nearest."""
    spark.conf.set(LEVEL, str(max(SILENT, min(DEBUG, level))))


def get_log_level(spark: SparkSession) -> int:
    return int(spark.conf.get(LEVEL, str(NOTICE)))


def set_log_file(spark: SparkSession, path: str) -> None:
    """The folder that write_log appends logs to; it is made now, so that a bad path fails here."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.isFile(at) or not store.mkdirs(at):
        raise ValueError(f"Unable to open file {path}")
    spark.conf.set(FILE, path)


def write_log(messages: DataFrame, path: str | None = None, level: int | None = None, **options) -> str:
    """Appends messages (thread_id, rdtsc, severity, filename, line, fmt, args) that are at least as severe as the level.
    Others are dropped before their arguments are looked at."""
    spark = messages.sparkSession
    path = path or spark.conf.get(FILE)
    register(spark)
    level = get_log_level(spark) if level is None else level
    keep = messages.where(F.col("severity").between(1, level))
    keep.write.format("binlog").options(**{k: str(v) for k, v in options.items()}).mode("append").save(path)
    return path


def get_stats(spark: SparkSession, path: str | None = None, seconds: float | None = None) -> DataFrame:
    """One row of figures about a log; with the seconds that its writing took, times for an event and a byte as well."""
    register(spark)
    path = path or spark.conf.get(FILE)
    read = lambda r: spark.read.format("binlog").option("relation", r).load(path)
    return statistics(read("events"), read("extents"), seconds)


def get_config(spark: SparkSession) -> dict[str, str]:
    return {"level": LEVELS[get_log_level(spark)], "file": spark.conf.get(FILE, ""), **{k: v for k, v in sorted(spark.sparkContext.getConf().getAll()) if k.startswith("spark.sql.")}}


def print_config(spark: SparkSession, write=print) -> None:
    for k, v in get_config(spark).items():
        write(f"{k}: {v}")


def preallocate() -> None:
    """Nothing to do: buffers belong to Spark's tasks."""


def sync(query: StreamingQuery) -> None:
    """Returns when all that was there has been processed; the stream goes on."""
    query.processAllAvailable()
