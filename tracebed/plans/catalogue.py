"""The queries of the log engine over the events table, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import aggregate as agg
from ..operators import render, select, timing
from ..schema import DEBUG, ERROR, NOTICE, SILENT, WARNING
from . import logview
from .logview import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql if sql.lstrip().upper().startswith("WITH") else SQL + sql
        return fn

    return add


def log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, dictionary and executions."""
    x = logview.executions(spark, sf_dir)
    return logview.events(spark, sf_dir), logview.dictionary(spark, x), x


# --- scans and orders ---------------------------------------------------------------------------------------------------


@query("scan_file_order", "SELECT execution_id, extent_id, seq, thread_id, log_id, rdtsc FROM e")
def scan_file_order(spark, sf_dir):
    return select.in_file_order(logview.events(spark, sf_dir)).select("execution_id", "extent_id", "seq", "thread_id", "log_id", "rdtsc")


@query("decompress_ordered", "SELECT execution_id, row_number() OVER (PARTITION BY execution_id ORDER BY rdtsc, stage_id, extent_id, seq) AS position, rdtsc, thread_id, message FROM m")
def decompress_ordered(spark, sf_dir):
    e, d, _ = log(spark, sf_dir)
    return render.message(select.positions(e), d).select("execution_id", "position", "rdtsc", "thread_id", "message")


@query("decompress_unordered", "SELECT execution_id, extent_id, seq, message FROM m")
def decompress_unordered(spark, sf_dir):
    e, d, _ = log(spark, sf_dir)
    return render.message(e, d).select("execution_id", "extent_id", "seq", "message")


@query("bounded_merge")
def bounded_merge(spark, sf_dir):
    return select.in_time_order(logview.events(spark, sf_dir).drop("args"), bounded=True).select("execution_id", "rdtsc", "seq")


@query(
    "render_lines",
    """SELECT seq, strftime(make_timestamp(((rdtsc // 1000000000) + 1704067200) * 1000000), '%Y-%m-%d %H:%M:%S') || '.' || printf('%09d', rdtsc % 1000000000)
    || ' ' || filename || ':' || line || ' ' || ['(none)', 'ERROR', 'WARNING', 'NOTICE', 'DEBUG'][severity + 1] || '[' || thread_id || ']: ' || message AS line_text FROM m""",
)
def render_lines(spark, sf_dir):
    # Microsecond steps of a 1 GHz clock: doubles hold their seconds and nanoseconds exactly enough to round.
    return render.lines(*log(spark, sf_dir)).select("seq", "line_text")


@query("wall_clock", "SELECT seq, 1704067200 + rdtsc // 1000000000 AS epoch_seconds, rdtsc % 1000000000 AS nanos, printf('%09d', rdtsc % 1000000000) AS digits FROM e")
def wall_clock(spark, sf_dir):
    e, _, x = log(spark, sf_dir)
    return render.with_clock(e, x).select("seq", "epoch_seconds", "nanos", F.format_string("%09d", "nanos").alias("digits"))


@query("wall_clock_before_checkpoint", "SELECT seq, 1704067200 + (rdtsc - 4000000000000000) // 1000000000 - CASE WHEN (rdtsc - 4000000000000000) % 1000000000 < 0 AND (rdtsc - 4000000000000000) // 1000000000 * 1000000000 > rdtsc - 4000000000000000 THEN 1 ELSE 0 END AS epoch_seconds, ((rdtsc - 4000000000000000) % 1000000000 + 1000000000) % 1000000000 AS nanos FROM e")
def wall_clock_before_checkpoint(spark, sf_dir):
    """All events before a checkpoint that is near enough for doubles to hold the microseconds of what lies between."""
    e, _, x = log(spark, sf_dir)
    late = x.withColumn("ckpt_rdtsc", F.lit(4_000_000_000_000_000).cast("long"))
    return render.with_clock(e, late).select("seq", "epoch_seconds", "nanos")


@query(
    "cycles_conversions",
    "SELECT seq, rdtsc / 2.5e9 AS seconds, CAST(floor(1e9 * rdtsc / 2.5e9 + 0.5) AS BIGINT) AS nanos, CAST(floor(1e9 * rdtsc / 2.5e9 + 0.5) AS BIGINT) // 1000 AS micros, CAST(floor(seq * 0.25 * 2.5e9 + 0.5) AS BIGINT) AS cycles, CAST(floor(CAST(seq AS DOUBLE) * 2.5e9 / 1e9 + 0.5) AS BIGINT) AS cycles_of_nanos FROM e",
)
def cycles_conversions(spark, sf_dir):
    t, cps = F.col("rdtsc"), F.lit(2.5e9)
    return logview.events(spark, sf_dir).select(
        "seq",
        clock.to_seconds(t, cps).alias("seconds"),
        clock.to_nanoseconds(t, cps).alias("nanos"),
        clock.to_microseconds(t, cps).alias("micros"),
        clock.from_seconds(F.col("seq") * 0.25, cps).alias("cycles"),
        clock.from_nanoseconds(F.col("seq"), cps).alias("cycles_of_nanos"),
    )


# --- filters and dictionary -------------------------------------------------------------------------------------------

for _name, _level in (("silent", SILENT), ("error", ERROR), ("warning", WARNING), ("notice", NOTICE), ("debug", DEBUG)):

    def _filtered(spark, sf_dir, level=_level):
        e, d, _ = log(spark, sf_dir)
        return select.by_severity(e, d, level).groupBy("severity").agg(F.count("*").alias("n"))

    query(f"log_level_filter_{_name}", f"SELECT severity, count(*) AS n FROM m WHERE severity <= {_level} GROUP BY severity")(_filtered)


@query("filter_by_id", "SELECT seq, thread_id, rdtsc, arg0 FROM e WHERE log_id = 2")
def filter_by_id(spark, sf_dir):
    return select.by_id(logview.events(spark, sf_dir), 2).select("seq", "thread_id", "rdtsc", "arg0")


def _found(needle):
    def run(spark, sf_dir):
        _, d, _ = log(spark, sf_dir)
        return select.find(d.where("execution_id = 0"), needle)

    return run


for _name, _needle in (("find_substring", "user"), ("find_empty", ""), ("find_case", "hello")):
    query(_name, f"SELECT log_id, filename, line, fmt FROM d WHERE contains(fmt, '{_needle}')")(_found(_needle))


@query(
    "find_numbering",
    r"""SELECT filename, line, fmt, row_number() OVER (ORDER BY '__' || array_to_string([CASE WHEN regexp_matches(c, '[\p{L}\p{N}]') THEN c ELSE CAST(unicode(c) AS VARCHAR) END FOR c IN string_split(fmt, '')], '')
    || '__' || array_to_string([CASE WHEN regexp_matches(c, '[\p{L}\p{N}]') THEN c ELSE CAST(unicode(c) AS VARCHAR) END FOR c IN string_split(filename, '')], '') || '__' || line || '__') - 1 AS canonical_id FROM d""",
)
def find_numbering(spark, sf_dir):
    _, d, _ = log(spark, sf_dir)
    return select.numbered(d.where("execution_id = 0")).select("filename", "line", "fmt", "canonical_id")


@query("dictionary_join", "SELECT filename, line, count(*) AS n FROM m GROUP BY filename, line")
def dictionary_join(spark, sf_dir):
    e, d, _ = log(spark, sf_dir)
    return render.with_dictionary(e, d).groupBy("filename", "line").agg(F.count("*").alias("n"))


@query("dictionary_anti_join", "SELECT log_id, count(*) AS n FROM e WHERE log_id = 4 GROUP BY log_id")
def dictionary_anti_join(spark, sf_dir):
    """With one statement taken out of the dictionary, its messages are found."""
    e, d, _ = log(spark, sf_dir)
    return select.unknown(e, d.where("log_id != 4")).groupBy("log_id").agg(F.count("*").alias("n"))


@query("clock_join", "SELECT execution_id, min(rdtsc - execution_id * 1000) AS first_passed, max(rdtsc - execution_id * 1000) AS last_passed FROM e GROUP BY execution_id")
def clock_join(spark, sf_dir):
    e, _, x = log(spark, sf_dir)
    own = x.withColumn("ckpt_rdtsc", F.col("execution_id").cast("long") * 1000)
    passed = F.col("rdtsc") - F.col("ckpt_rdtsc")
    return render.with_clock(e, own).groupBy("execution_id").agg(F.min(passed).alias("first_passed"), F.max(passed).alias("last_passed"))


@query("dictionary_merge_latest", "SELECT log_id, CASE WHEN log_id >= 3 THEN line + 100 ELSE line END AS line, fmt FROM d")
def dictionary_merge_latest(spark, sf_dir):
    _, d, _ = log(spark, sf_dir)
    one = d.where("execution_id = 0").select("log_id", "line", "fmt")
    return select.merged([one, one.where("log_id >= 3").withColumn("line", F.col("line") + 100)])


@query("param_signature_histogram", "SELECT CASE log_id WHEN 2 THEN 'int_t, unsigned_long_int_t, const_char_ptr_t' WHEN 4 THEN 'int_t' ELSE 'int_t, unsigned_long_int_t' END AS signature, count(*) AS statements FROM d GROUP BY 1")
def param_signature_histogram(spark, sf_dir):
    _, d, _ = log(spark, sf_dir)
    return select.signatures(d.where("execution_id = 0"))


@query("format_param_types", "SELECT log_id, i - 1 AS position, CASE WHEN i = 1 THEN 'int_t' WHEN i = 2 THEN 'unsigned_long_int_t' ELSE 'const_char_ptr_t' END AS arg_type FROM d, range(1, 4) AS r(i) WHERE i <= CASE log_id WHEN 2 THEN 3 WHEN 4 THEN 1 ELSE 2 END")
def format_param_types(spark, sf_dir):
    _, d, _ = log(spark, sf_dir)
    return d.where("execution_id = 0").select("log_id", F.posexplode("fragments").alias("position", "f")).select("log_id", F.col("position").cast("long").alias("position"), "f.arg_type")


# --- aggregates ---------------------------------------------------------------------------------------------------------

_MMM = """SELECT count(*) AS num_logs, count(*) FILTER ({p}) AS matching, CAST(min({v}) FILTER ({p}) AS BIGINT) AS min, CAST(max({v}) FILTER ({p}) AS BIGINT) AS max, CAST(sum({v}) FILTER ({p}) AS BIGINT) AS total,
    CAST(sum({v}) FILTER ({p}) AS BIGINT) // nullif(count(*) FILTER ({p}), 0) AS mean, 100.0::DOUBLE * (count(*) FILTER ({p})) / nullif(count(*), 0) AS pct FROM e"""


@query("min_max_mean", _MMM.format(p="log_id = 0", v="arg0"))
def min_max_mean(spark, sf_dir):
    return agg.min_max_mean(logview.events(spark, sf_dir), 0)


for _id in range(1, 5):
    query(f"min_max_mean_id{_id}", _MMM.format(p=f"log_id = {_id}", v="arg0"))(lambda spark, sf_dir, i=_id: agg.min_max_mean(logview.events(spark, sf_dir), i))


@query("min_max_mean_no_match", _MMM.format(p="log_id = 99", v="arg0"))
def min_max_mean_no_match(spark, sf_dir):
    return agg.min_max_mean(logview.events(spark, sf_dir), 99)


@query("min_max_mean_int32_wrap", _MMM.format(p="log_id = 1", v="(CASE WHEN (rdtsc & 4294967295) >= 2147483648 THEN (rdtsc & 4294967295) - 4294967296 ELSE rdtsc & 4294967295 END)"))
def min_max_mean_int32_wrap(spark, sf_dir):
    return agg.min_max_mean(logview.events(spark, sf_dir), 1, agg.wrap32(F.col("rdtsc")))


@query("count_by_id", "SELECT log_id, count(*) AS n FROM e GROUP BY log_id")
def count_by_id(spark, sf_dir):
    return agg.count_by_id(logview.events(spark, sf_dir))


@query("callback_aggregate", "SELECT execution_id, count(*) AS n, CAST(sum(arg0) AS BIGINT) AS total FROM e WHERE log_id = 3 GROUP BY execution_id")
def callback_aggregate(spark, sf_dir):
    import pandas as pd

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"execution_id": [pdf["execution_id"].iloc[0]], "n": [len(pdf)], "total": [int(pdf["arg0"].sum())]})

    return agg.aggregate_with(logview.events(spark, sf_dir).select("file", "execution_id", "log_id", "arg0"), 3, fn, "execution_id int, n bigint, total bigint")


_LINE = "SELECT message AS line_text FROM m"


def messages(spark, sf_dir):
    e, d, _ = log(spark, sf_dir)
    return render.message(e, d).select(F.col("message").alias("line_text"))


@query("text_find_aggregate", "SELECT CAST(min(arg0) AS BIGINT) AS min, CAST(max(arg0) AS BIGINT) AS max, CAST(sum(arg0) AS BIGINT) // nullif(count(*), 0) AS mean, CAST(sum(arg0) AS BIGINT) AS total, count(*) AS matching FROM m WHERE contains(message, 'Hello World # ')")
def text_find_aggregate(spark, sf_dir):
    return agg.text_totals(messages(spark, sf_dir), "Hello World # ")


@query("text_regex_aggregate", "SELECT min(v) AS min, max(v) AS max, CAST(sum(v) AS BIGINT) // nullif(count(*), 0) AS mean, CAST(sum(v) AS BIGINT) AS total, count(*) AS matching FROM (SELECT CAST(regexp_extract(message, '^.*# (\\d+)', 1) AS BIGINT) AS v FROM m WHERE regexp_matches(message, '^.*# (\\d+)'))")
def text_regex_aggregate(spark, sf_dir):
    return agg.regex_totals(messages(spark, sf_dir))


@query("text_awk_mean", "SELECT avg(CAST(arg0 AS DOUBLE)) AS mean, count(*) AS matching FROM m WHERE contains(message, 'Hello World')")
def text_awk_mean(spark, sf_dir):
    return agg.field_mean(messages(spark, sf_dir), "Hello World", 4)


@query("documents_text_aggregate", "WITH x AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) SELECT count(*) AS lines, count(*) FILTER (contains(line, 'the ')) AS matching, max(length(line)) AS longest FROM x")
def documents_text_aggregate(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return line.agg(F.count("*").alias("lines"), F.count_if(F.contains(F.col("line"), F.lit("the "))).alias("matching"), F.max(F.length("line")).cast("long").alias("longest"))


@query("extent_stats", "SELECT execution_id, extent_id, stage_id, thread_id, count(*) AS messages, CAST(sum(10 + length(event_type)) AS BIGINT) AS bytes FROM e GROUP BY ALL")
def extent_stats(spark, sf_dir):
    return agg.extents(logview.events(spark, sf_dir), F.length("event_type") + 10).drop("file")


@query("read_counters", "SELECT count(*) AS messages, count(DISTINCT (execution_id, extent_id)) AS extents, count(DISTINCT execution_id) AS executions FROM e")
def read_counters(spark, sf_dir):
    return agg.counters(logview.events(spark, sf_dir))


#: Bytes of a message before it is packed, in SQL: head, an int, and what its kind adds.
_ENTRY = "(16 + 4 + CASE log_id WHEN 2 THEN 8 + 4 + length(event_type) WHEN 4 THEN 0 ELSE 8 END)"
_BINS = "SELECT CAST(r AS INTEGER) AS bin, count(b.bin) AS n FROM range(20) AS t(r) LEFT JOIN b ON b.bin = r GROUP BY r"


@query("size_histogram", SQL.rstrip() + f", x AS (SELECT sum({_ENTRY}) AS bytes FROM e GROUP BY execution_id, extent_id), b AS (SELECT CAST(least(20 * bytes // 4096, 19) AS INTEGER) AS bin FROM x) {_BINS}")
def size_histogram(spark, sf_dir):
    """Bytes recorded of each extent, as shares of a buffer of 4 KB."""
    return agg.size_histogram(agg.extents(logview.events(spark, sf_dir), agg.entry_bytes()), 4096)


@query("overflow_histogram", SQL.rstrip() + f", x AS (SELECT rdtsc - lag(rdtsc) OVER (PARTITION BY execution_id, thread_id ORDER BY extent_id, seq) AS wait FROM e), b AS (SELECT CAST(greatest(0, least(floor(wait / 1e9), 19)) AS INTEGER) AS bin FROM x WHERE wait >= 0) {_BINS}")
def overflow_histogram(spark, sf_dir):
    """Times between the messages of a thread, in seconds; the last bin has all longer ones."""
    d = timing.deltas(logview.events(spark, sf_dir)).where("delta >= 0")
    return agg.wait_histogram(d.withColumn("wait", F.col("delta")), 1e9)


@query("thread_counters", SQL.rstrip() + f", x AS (SELECT *, coalesce(rdtsc - lag(rdtsc) OVER (PARTITION BY execution_id, thread_id ORDER BY extent_id, seq), 0) AS wait FROM e) SELECT thread_id, count(*) AS messages, CAST(sum({_ENTRY}) AS BIGINT) AS bytes, count(*) FILTER (wait > 0) AS blocked, CAST(sum(wait) AS BIGINT) AS blocked_ns FROM x GROUP BY thread_id")
def thread_counters(spark, sf_dir):
    from pyspark.sql import Window

    e = logview.events(spark, sf_dir)
    order = Window.partitionBy("file", "execution_id", "thread_id").orderBy("extent_id", "seq")
    waited = e.withColumn("wait", F.coalesce(F.col("rdtsc") - F.lag("rdtsc").over(order), F.lit(0)))
    return agg.by_thread(waited, agg.entry_bytes(), F.col("wait"))


@query("log_statistics", SQL.rstrip() + f", x AS (SELECT CAST(sum({_ENTRY}) AS BIGINT) AS bytes_in, count(*) AS events, CAST(count(*) * 10 AS BIGINT) AS bytes_out FROM e), y AS (SELECT *, (512 - bytes_out % 512) % 512 AS pad_bytes FROM x) SELECT events, bytes_in, bytes_out, pad_bytes, CAST(bytes_in AS DOUBLE) / (bytes_out + pad_bytes) AS ratio_padded, CAST(bytes_in AS DOUBLE) / bytes_out AS ratio, CAST(bytes_out AS DOUBLE) / events AS bytes_per_event, bytes_out / 1e6 / 2.0 AS mb_per_second, 2e9 / bytes_out AS ns_per_byte, 2e9 / events AS ns_per_event FROM y")
def log_statistics(spark, sf_dir):
    """Figures of a log written in two seconds, at ten bytes a message."""
    e = logview.events(spark, sf_dir)
    return agg.statistics(e, agg.extents(e, F.lit(10)), 2.0)


@query("min_max_mean_by_statement", "SELECT filename, line, fmt, count(*) AS matching, CAST(min(arg0) AS BIGINT) AS min, CAST(max(arg0) AS BIGINT) AS max, CAST(sum(arg0) AS BIGINT) AS total, CAST(sum(arg0) AS BIGINT) // count(*) AS mean FROM m WHERE log_id = 3 GROUP BY filename, line, fmt")
def min_max_mean_by_statement(spark, sf_dir):
    e, d, _ = log(spark, sf_dir)
    return agg.min_max_mean_by_statement(e, d, 3)


@query("min_max_mean_compat", _MMM.format(p="log_id = 2", v="arg0"))
def min_max_mean_compat(spark, sf_dir):
    """Low 32 bits: the same as typed values here, where arguments are ints."""
    return agg.min_max_mean(logview.events(spark, sf_dir), 2, compat=True)


@query("log_level_session", "SELECT severity, count(*) AS n FROM m WHERE severity <= 2 GROUP BY severity")
def log_level_session(spark, sf_dir):
    """The level is a setting of the session."""
    from .. import engine

    before = engine.get_log_level(spark)
    engine.set_log_level(spark, WARNING)
    try:
        e, d, _ = log(spark, sf_dir)
        return select.by_severity(e, d).groupBy("severity").agg(F.count("*").alias("n"))
    finally:
        engine.set_log_level(spark, before)


@query("argument_accessors", "SELECT seq, CAST(arg0 AS BIGINT) AS first, CASE WHEN log_id = 4 THEN NULL ELSE user_id END AS second, CASE WHEN log_id = 2 THEN event_type END AS third, CASE log_id WHEN 2 THEN 3 WHEN 4 THEN 1 ELSE 2 END AS n FROM e")
def argument_accessors(spark, sf_dir):
    return logview.events(spark, sf_dir).select("seq", agg.argument(0, "i").alias("first"), agg.argument(1, "u").cast("long").alias("second"), agg.argument(2, "s").alias("third"), agg.num_args().alias("n"))


_NOTE = "Took %*d | %-8.3s | %08.2lf | %+ld | %#x | %e"


@query(
    "render_formats",
    SQL.rstrip() + """, n AS (SELECT seq, arg0, user_id, event_type, rdtsc % 1000000 / 1000.0 AS ms FROM e)
    SELECT seq, 'Took ' || printf('%6d', arg0) || ' | ' || rpad(left(event_type, 3), 8, ' ') || ' | ' || printf('%08.2f', ms) || ' | ' || printf('%+d', user_id) || ' | ' || CASE WHEN arg0 = 0 THEN '0' ELSE '0x' || lower(to_hex(arg0)) END || ' | ' || printf('%e', ms) AS message FROM n""",
)
def render_formats(spark, sf_dir):
    """Flags, widths, precisions and floats go through C's rules."""
    from ..schema import ARG, DICTIONARY

    none = "cast(null as int)"
    fields = {"i": "cast(null as bigint)", "u": "cast(null as decimal(20,0))", "d": "cast(null as double)", "s": "cast(null as string)"}

    def arg(kind, width=none, **own):
        rest = ", ".join(f"'{k}', {own.get(k, v)}" for k, v in fields.items())
        return f"named_struct('type', '{kind}', 'width', {width}, 'prec', {none}, {rest}, 'b', cast(null as binary))"

    args = (arg("int_t", "6", i="cast(arg0 as bigint)"), arg("const_char_ptr_t", s="event_type"), arg("double_t", d="cast(rdtsc % 1000000 as double) / 1000.0"), arg("long_int_t", i="user_id"), arg("unsigned_int_t", i="cast(arg0 as bigint)"), arg("double_t", d="cast(rdtsc % 1000000 as double) / 1000.0"))
    e = logview.events(spark, sf_dir).withColumn("log_id", F.lit(0).cast("long")).withColumn("args", F.expr(f"cast(array({', '.join(args)}) as array<{ARG}>)"))
    one = spark.createDataFrame([(logview.FILE, 0, 0, "f.cc", 1, 3, _NOTE, 7, [], True)], DICTIONARY).drop("execution_id")
    d = logview.executions(spark, sf_dir).select("execution_id").crossJoin(F.broadcast(one))  # one row
    return render.message(e, d).select("seq", "message")


@query("unknown_statements", "SELECT log_id, count(*) AS n, count(*) FILTER (log_id = 4) AS without FROM e GROUP BY log_id")
def unknown_statements(spark, sf_dir):
    """A statement that is no format leaves its messages without text, and loses none."""
    e, d, _ = log(spark, sf_dir)
    bad = d.withColumn("valid", F.col("log_id") != 4)
    return render.message(e, bad).groupBy("log_id").agg(F.count("*").alias("n"), F.count_if(F.col("message").isNull()).alias("without"))


@query("canonical_order_of_lines", "SELECT line, row_number() OVER (ORDER BY '__a__f46cc__' || line || '__') - 1 AS canonical_id FROM (SELECT unnest([1, 2, 10, 20, 21, 200]) AS line)")
def canonical_order_of_lines(spark, sf_dir):
    """Line 20 is before line 2: names end with a mark, and digits come before it."""
    d = spark.createDataFrame([(n, "f.cc", "a") for n in (1, 2, 10, 20, 21, 200)], "line int, filename string, fmt string")
    return select.numbered(d).select("line", "canonical_id")


# --- times --------------------------------------------------------------------------------------------------------------

_DELTA = SQL.rstrip() + ", x AS (SELECT execution_id, thread_id, seq, rdtsc - lag(rdtsc) OVER (PARTITION BY execution_id, thread_id ORDER BY extent_id, seq) AS delta FROM e), y AS (SELECT * FROM x WHERE delta IS NOT NULL)"


@query("rcdf_deltas", _DELTA + " SELECT execution_id, thread_id, seq, delta FROM y")
def rcdf_deltas(spark, sf_dir):
    return timing.deltas(logview.events(spark, sf_dir)).select("execution_id", "thread_id", "seq", "delta")


@query("rcdf_file_deltas", SQL.rstrip() + ", x AS (SELECT seq, rdtsc - lag(rdtsc) OVER (ORDER BY execution_id, extent_id, seq) AS delta FROM e) SELECT seq, delta FROM x WHERE delta IS NOT NULL")
def rcdf_file_deltas(spark, sf_dir):
    return timing.deltas(logview.events(spark, sf_dir), within=("file",)).select("seq", "delta")


@query(
    "rcdf_curve",
    _DELTA
    + """, c AS (SELECT delta AS cycles, count(*) AS n FROM y GROUP BY delta), s AS (SELECT cycles, sum(n) OVER (ORDER BY cycles) AS upto, sum(n) OVER () AS total, max(cycles) OVER () AS last, min(cycles) OVER () AS first FROM c)
    SELECT cycles, 1.0::DOUBLE AS fraction, 'first' AS point FROM s WHERE cycles = first UNION ALL SELECT cycles, 1 - CAST(upto AS DOUBLE) / total, 'inner' FROM s WHERE cycles < last UNION ALL SELECT cycles, 1.0::DOUBLE / total, 'last' FROM s WHERE cycles = last""",
)
def rcdf_curve(spark, sf_dir):
    return timing.rcdf(timing.deltas(logview.events(spark, sf_dir)))


@query("rcdf_mean", _DELTA + " SELECT count(*) AS n, CAST(sum(delta) - min(delta) AS BIGINT) // nullif(count(*), 0) AS mean_cycles FROM y")
def rcdf_mean(spark, sf_dir):
    return timing.rcdf_mean(timing.deltas(logview.events(spark, sf_dir)))


@query(
    "time_trace_merge",
    SQL.rstrip()
    + """, r AS (SELECT thread_id AS buffer_idx, seq AS slot, rdtsc AS timestamp, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS k FROM e), kept AS (SELECT * FROM r WHERE k < 8192),
    st AS (SELECT max(o) AS start FROM (SELECT min(timestamp) AS o FROM kept GROUP BY buffer_idx)), t AS (SELECT buffer_idx, slot, CAST(timestamp - start AS DOUBLE) / 1e9 * 1e9 AS ns, row_number() OVER (ORDER BY timestamp, buffer_idx, slot) - 1 AS position FROM kept, st WHERE timestamp >= start)
    SELECT buffer_idx, slot, position, CAST(round(ns) AS BIGINT) AS ns, CAST(round(ns - lag(ns, 1, 0.0) OVER (ORDER BY position)) AS BIGINT) AS delta_ns FROM t""",
)
def time_trace_merge(spark, sf_dir):
    e = logview.events(spark, sf_dir)
    r = e.select(F.col("thread_id").alias("buffer_idx"), F.col("seq").alias("slot"), F.col("rdtsc").alias("timestamp"))
    return timing.trace(r).select("buffer_idx", "slot", "position", F.round("ns").cast("long").alias("ns"), F.round("delta_ns").cast("long").alias("delta_ns"))


# --- selectivity ---------------------------------------------------------------------------------------------------------

for _percent in (100, 50, 10, 1):
    query(f"selectivity_{_percent}", f"WITH x AS (SELECT l_partkey FROM lineitem WHERE l_orderkey % 100 < {_percent}) SELECT count(*) AS matching, min(l_partkey) AS min, max(l_partkey) AS max, CAST(sum(l_partkey) AS BIGINT) AS total, CAST(sum(l_partkey) AS BIGINT) // count(*) AS mean FROM x")(
        lambda spark, sf_dir, p=_percent: spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_orderkey") % 100 < p).agg(F.count("*").alias("matching"), F.min("l_partkey").alias("min"), F.max("l_partkey").alias("max"), F.sum("l_partkey").alias("total"), F.expr("sum(l_partkey) div count(*)").alias("mean"))
    )



# --- binary logs and streams -----------------------------------------------------------------------------------------


@query("binlog_roundtrip", "SELECT thread_id, rdtsc, seq, message FROM m")
def binlog_roundtrip(spark, sf_dir):
    """Messages written as binary logs, read back by extents and rendered by the logs' own dictionaries."""
    from ..schema import ARG
    from ..sources.binlog import scratch_log

    # As many logs as there are tasks' worth of events, each with all messages that some threads wrote in some executions.
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(F.expr("event_id div 2500"), F.expr("user_id % 8"))
    e, d = logview.shaped(raw), logview.dictionary(spark, logview.executions(spark, sf_dir))
    # The sequence number is the last argument of each message, as times need not tell messages apart.
    number = F.expr(f"cast(array(named_struct('type', 'unsigned_long_int_t', 'width', null, 'prec', null, 'i', null, 'u', seq, 'd', null, 's', null, 'b', null)) as array<{ARG}>)")
    rows = render.with_dictionary(e, d).select("thread_id", "rdtsc", "severity", "filename", "line", F.concat("fmt", F.lit(" #%lu")).alias("fmt"), F.concat("args", number).alias("args"))
    path = scratch_log(rows)
    read = spark.read.format("binlog").load(path)
    known = spark.read.format("binlog").option("relation", "dictionary").load(path)
    # Five statements of each log, whose number the session's shuffle partitions bound.
    back = render.message(read, F.broadcast(known)).withColumn("seq", F.expr("cast(element_at(args, -1).u as bigint)"))
    return back.select("thread_id", "rdtsc", "seq", F.expr("left(message, length(message) - length(concat(' #', seq)))").alias("message"))


@query("text_source_aggregate", "SELECT CAST(min(arg0) AS BIGINT) AS min, CAST(max(arg0) AS BIGINT) AS max, CAST(sum(arg0) AS BIGINT) // nullif(count(*), 0) AS mean, CAST(sum(arg0) AS BIGINT) AS total, count(*) AS matching FROM m WHERE log_id = 4")
def text_source_aggregate(spark, sf_dir):
    """Lines rendered to text files in order, with markers and footer, read back as text."""
    from ..shared import shared
    from ..sources.text import text_lines

    path = shared(spark, "text")
    render.write_text(render.lines(*log(spark, sf_dir)), path)
    return agg.text_totals(text_lines(spark, f"{path}/*"), "Hello World # ")


@query("text_raw_read", "SELECT count(*) AS lines, CAST(sum(length(message)) AS BIGINT) AS characters FROM m")
def text_raw_read(spark, sf_dir):
    from ..shared import shared
    from ..sources.text import raw_read

    path = shared(spark, "text")
    messages(spark, sf_dir).write.text(path)
    return raw_read(spark, path)


@query("log_write_level", "SELECT severity, count(*) AS n FROM m WHERE severity <= 2 GROUP BY severity")
def log_write_level(spark, sf_dir):
    """Messages below the level never reach the log."""
    from .. import engine
    from ..shared import shared

    e, d, _ = log(spark, sf_dir)
    rows = render.with_dictionary(e, d).select("thread_id", "rdtsc", "severity", "filename", "line", "fmt", "args")
    path = engine.write_log(rows, shared(spark, "log"), WARNING)
    read = lambda r: spark.read.format("binlog").option("relation", r).load(path)
    return render.with_dictionary(read("events"), read("dictionary")).groupBy("severity").agg(F.count("*").alias("n"))


def event_stream(spark, sf_dir):
    return logview.shaped(spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir))


@query("stream_log_roundtrip", "SELECT log_id AS own_id, count(*) AS n, CAST(sum(rdtsc % 1000000007) AS BIGINT) AS mark FROM e GROUP BY log_id")
def stream_log_roundtrip(spark, sf_dir):
    """A stream written as binary logs, and read back as a stream of at most two files at a time."""
    from ..shared import shared
    from ..sources.binlog import register, stream_files

    register(spark)
    path, out = shared(spark, "log"), shared(spark, "events")
    sites = spark.createDataFrame([(i, *site) for i, site in enumerate(logview.SITES)], "log_id bigint, filename string, line bigint, severity int, fmt string")
    rows = event_stream(spark, sf_dir).join(F.broadcast(sites), "log_id").select("thread_id", "rdtsc", "severity", "filename", "line", "fmt", "args")
    rows.writeStream.format("binlog").option("path", path).option("checkpointLocation", shared(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    back = stream_files(spark, path, 2, ["file", "execution_id", "log_id", "rdtsc"])
    back.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    known = spark.read.format("binlog").option("relation", "dictionary").load(path).select("file", "execution_id", "log_id", "line").withColumn("file", F.regexp_extract("file", "[^/]*$", 0))
    read = spark.read.schema(back.schema).parquet(out)
    # Messages are counted by their logs' own statements, and then these joined, so no message is shuffled.
    counted = read.groupBy("file", "execution_id", "log_id").agg(F.count("*").alias("n"), F.sum(F.expr("rdtsc % 1000000007")).alias("mark")).withColumn("file", F.regexp_extract("file", "[^/]*$", 0))
    named = counted.join(known, ["file", "execution_id", "log_id"]).join(F.broadcast(sites.select("line", F.col("log_id").alias("own_id"))), "line")
    return named.groupBy("own_id").agg(F.sum("n").alias("n"), F.sum("mark").alias("mark"))


@query(
    "stream_ordered",
    SQL.rstrip()
    + """, x AS (SELECT *, CASE WHEN stage_id <= max(stage_id) OVER (PARTITION BY execution_id) - 3 THEN 0 ELSE 1 END AS phase FROM e), y AS (SELECT *, coalesce(max(CASE WHEN phase = 0 THEN rdtsc END) OVER (PARTITION BY execution_id), -1) AS sent FROM x)
    SELECT execution_id, row_number() OVER (PARTITION BY execution_id ORDER BY phase, rdtsc, stage_id, extent_id, seq) AS position, seq, phase = 1 AND rdtsc < sent AS late FROM y""",
)
def stream_ordered(spark, sf_dir):
    """All but the last three stages first, these when the stream pauses; what is then behind what was sent is marked."""
    from ..streaming.ordered import drained

    n = logview.events(spark, sf_dir).count()
    return drained(event_stream(spark, sf_dir), n).select("execution_id", "position", "seq", "late")


@query("stream_counts", "SELECT log_id, count(*) AS n FROM e GROUP BY log_id")
def stream_counts(spark, sf_dir):
    from ..streaming.ordered import running_counts

    return running_counts(spark, event_stream(spark, sf_dir), "log_id")
