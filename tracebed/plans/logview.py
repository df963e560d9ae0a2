"""Log relations over the events table: executions of 2500 messages, eight threads, ten stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fmt import num_nibbles, parse_format
from ..schema import ARG, DICTIONARY

#: log_id: filename, line, severity, format.
SITES = (
    ("server.cc", 20, 3, "Clicked item %d by user %lu"),
    ("server.cc", 31, 1, "Request failed with code %d for user %lu"),
    ("shop.cc", 42, 2, "Purchase of %d items by user %lu: %s"),
    ("server.cc", 53, 3, "Signup %d of user %lu"),
    ("shop.cc", 64, 4, "Hello World # %d"),
)
FILE = "events"
UNIX_TIME = 1704067200


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_events with arg0, the first argument as a number. Columns are plain expressions, so filters reach the scan."""
    return shaped(spark.read.parquet(f"{sf_dir}/events.parquet"))


def shaped(e: DataFrame) -> DataFrame:
    """Rows of the events table, or of a stream of it, as log_events."""
    log_id = F.expr("case event_type when 'click' then 0L when 'error' then 1L when 'purchase' then 2L when 'signup' then 3L else 4L end")
    k = F.get_json_object("props", "$.k").cast("int")
    none = "cast(null as int)"
    arg = lambda kind, i="cast(null as bigint)", u="cast(null as decimal(20,0))", s="cast(null as string)": f"named_struct('type', '{kind}', 'width', {none}, 'prec', {none}, 'i', {i}, 'u', {u}, 'd', cast(null as double), 's', {s}, 'b', cast(null as binary))"
    number, user, kind = arg("int_t", i="cast(arg0 as bigint)"), arg("unsigned_long_int_t", u="cast(user_id as decimal(20,0))"), arg("const_char_ptr_t", s="event_type")
    return e.select(
        F.lit(FILE).alias("file"),
        F.expr("cast(event_id div 2500 as int)").alias("execution_id"),
        F.expr("cast((event_id % 2500) div 250 as int)").alias("stage_id"),
        F.expr("((event_id % 2500) div 250) * 8 + user_id % 8").alias("extent_id"),
        F.col("event_id").alias("seq"),
        F.expr("user_id % 8").alias("thread_id"),
        log_id.alias("log_id"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', ts) * 1000").alias("rdtsc"),
        "user_id",
        "event_type",
        k.alias("arg0"),
    ).withColumn("args", F.expr(f"cast(case when log_id = 2 then array({number}, {user}, {kind}) when log_id = 4 then array({number}) else array({number}, {user}) end as array<{ARG}>)"))


def dictionary(spark: SparkSession, executions: DataFrame) -> DataFrame:
    """The statements of each execution."""
    rows = []
    for i, (filename, line, severity, fmt) in enumerate(SITES):
        pieces = parse_format(fmt)
        rows.append((FILE, 0, i, filename, line, severity, fmt, num_nibbles(pieces), [(p.arg_type, p.dyn_width, p.dyn_prec, p.fragment) for p in pieces], True))
    one = spark.createDataFrame(rows, DICTIONARY).drop("file", "execution_id")
    return executions.select("file", "execution_id").crossJoin(F.broadcast(one))


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint for each execution; their number follows from the largest event_id, which Parquet knows from its footers."""
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id").alias("last"))
    return last.select(F.lit(FILE).alias("file"), F.explode(F.expr("sequence(0, cast(last div 2500 as int))")).alias("execution_id"), F.lit(0).cast("long").alias("ckpt_rdtsc"), F.lit(UNIX_TIME).cast("long").alias("unix_time"), F.lit(1e9).alias("cycles_per_second"))


# --- the same in SQL ----------------------------------------------------------------------------------------------------

_VALUES = ", ".join(f"({i}, '{a}', {b}, {c}, '{d}')" for i, (a, b, c, d) in enumerate(SITES))
SQL = f"""
WITH d AS (SELECT CAST(column0 AS BIGINT) AS log_id, column1 AS filename, CAST(column2 AS BIGINT) AS line, CAST(column3 AS INTEGER) AS severity, column4 AS fmt FROM (VALUES {_VALUES}) AS v(column0, column1, column2, column3, column4)),
e AS (SELECT CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS BIGINT) AS log_id,
    CAST(event_id // 2500 AS INTEGER) AS execution_id, CAST((event_id % 2500) // 250 AS INTEGER) AS stage_id, user_id % 8 AS thread_id,
    ((event_id % 2500) // 250) * 8 + user_id % 8 AS extent_id, event_id AS seq, (epoch_us(ts) - 1704067200000000) * 1000 AS rdtsc,
    user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS arg0 FROM events),
m AS (SELECT e.*, d.filename, d.line, d.severity, d.fmt, CASE e.log_id WHEN 0 THEN 'Clicked item ' || arg0 || ' by user ' || user_id
    WHEN 1 THEN 'Request failed with code ' || arg0 || ' for user ' || user_id WHEN 2 THEN 'Purchase of ' || arg0 || ' items by user ' || user_id || ': ' || event_type
    WHEN 3 THEN 'Signup ' || arg0 || ' of user ' || user_id ELSE 'Hello World # ' || arg0 END AS message FROM e JOIN d USING (log_id))
"""
