"""Logs encoded, decoded and rendered by columns, against the format's message-by-message definition."""

import io
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracebed.functions.columnar import rendered
from tracebed.functions.fmt import Renderer, c_format, converter, specifiers
from tracebed.operators import render
from tracebed.plans import catalogue
from tracebed.sources import binlog
from tracebed.sources.columns import ARG_TYPES, Plan, args_array, decoded, packed
from tracebed.sources.wire import CorruptLog, Site, message_header, messages, packed_args, walk

FORMATS = ("no argument", "%d %lu %s", "%hhd %hu %hd %u %ld", "%f|%.3s|%x", "%*d %.*lf", "%Lf %ls", "%.*s", "%p %c %zd", "%s %s")


def argument(rng, f):
    """An argument as a row of the events has it, with all fields."""
    own = dict.fromkeys(ARG_TYPES) | {"type": f.arg_type}
    own |= ({"width": rng.randrange(-9, 9)} if f.dyn_width else {}) | ({"prec": rng.randrange(-1, 9)} if f.dyn_prec else {})
    if f.arg_type in ("const_char_ptr_t", "const_wchar_t_ptr_t"):
        return own | {"s": rng.choice(("", "abc", "déjà", "x" * 40))}
    if f.arg_type in ("double_t", "long_double_t"):
        return own | {"d": rng.choice((0.0, -0.0, 1.5, -2.25e300, float("inf"), 0.1))}
    n = rng.choice((0, 1, -1, 255, -256, 2**31 - 1, -(2**31), 2**40, -(2**40), -(2**63), 2**63 - 1))
    return own | ({"u": n % 2**64} if rng.random() < 0.5 else {"i": n})


def test_columns_are_what_messages_are():
    rng = random.Random(4)
    sites = [Site(3, "f.cc", k, fmt) for k, fmt in enumerate(FORMATS)]
    ids = np.array([rng.randrange(len(sites)) for _ in range(600)])
    rows = [[argument(rng, f) for f in sites[k].takes] for k in ids]
    args = pa.array([[], *rows], pa.list_(pa.struct(ARG_TYPES)))[1:]
    found = binlog.all_packed(sites, ids, args)
    assert found == [packed_args(sites[k], own) for k, own in zip(ids, rows, strict=True)]
    data, last = b"", 0
    for k, own in zip(ids.tolist(), found, strict=True):
        t = rng.choice((last + 5, last - 3, 2**62, 1))  # far back, too
        data, last = data + message_header(k, t, last) + own, t
    expected, plans = list(messages(data, sites)), [Plan(s) for s in sites]
    assert all(-(2**63) <= m.rdtsc < 2**63 for m in expected) and expected[-1].rdtsc == last
    out = decoded(data, plans)
    assert [(m.log_id, m.rdtsc) for m in expected] == list(zip(out.ids, out.times, strict=True))
    assert args_array(out, plans).to_pylist() == pa.array([m.args for m in expected], pa.list_(pa.struct(ARG_TYPES))).to_pylist()
    bare = decoded(data, plans, args=False)
    assert (bare.ids, bare.times, bare.values) == (out.ids, out.times, [])
    some = decoded(data, plans, only=3)
    assert some.seq == [k for k, x in enumerate(out.ids) if x == 3] and args_array(some, plans).to_pylist() == [m.args and own for m, own in zip(expected, args_array(out, plans).to_pylist(), strict=True) if m.log_id == 3]
    with pytest.raises(CorruptLog):
        decoded(data[:-1] + b"\x02", plans)


def test_bytes_that_are_no_text():
    site = Site(3, "f.cc", 1, "%s %d")
    row = [dict.fromkeys(ARG_TYPES) | {"b": b"\xff\xfe"}, dict.fromkeys(ARG_TYPES) | {"i": -4}]
    data = message_header(0, 9, 0) + packed(site, pa.array(row, pa.struct(ARG_TYPES)), np.array([0]))[0]
    (own,) = args_array(decoded(data, [Plan(site)]), [Plan(site)]).to_pylist()
    assert own[0]["b"] == b"\xff\xfe" and own[0]["s"] == "��" and own[1]["i"] == -4


def test_batches_are_written_in_extents_of_half_a_megabyte():
    row = {"rdtsc": 5, "severity": 3, "filename": "f.cc", "line": 7, "fmt": "%s %lu"}
    rows = [row | {"thread_id": k % 3, "args": [{"s": "a" * 999}, {"u": k}]} for k in range(3000)]
    out = io.BytesIO()
    out.write(binlog.checkpoint(0, 0, 1e9))
    assert binlog.Writer({}).encode(iter(pa.Table.from_pylist(rows, binlog.WRITTEN).to_batches(700)), out) == 3000
    out.seek(0)
    executions, extents = walk(out)
    data, seen = out.getvalue(), {}
    assert len(extents) == 6 and max(e.length for e in extents) <= 1 << 19
    for e in extents:
        found = decoded(data[e.offset : e.offset + e.length], [Plan(s) for s in executions[0].sites])
        seen.setdefault(e.thread_id, []).extend(found.values[1::2])
        assert set(found.times) == {5}
    assert seen == {t: list(range(t, 3000, 3)) for t in range(3)}


def test_one_file_of_a_stream_is_decoded_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binlog, "STEP", 1, raising=False)
    arg = f"named_struct({', '.join(repr(k) + ', ' + ('cast(id as bigint)' if k == 'i' else 'null') for k in ARG_TYPES)})"
    rows = spark.sql(f"select id % 8 as thread_id, id as rdtsc, 3 as severity, 'f.cc' as filename, 7L as line, '%d' as fmt, array({arg}) as args from range(1000)").coalesce(1)
    back = binlog.stream_files(spark, binlog.scratch_log(rows), 2).withColumn("task", F.spark_partition_id())
    back.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.v for r in found.selectExpr("args[0].i as v").collect()) == list(range(1000))
    assert found.select("file").distinct().count() == 1 and found.select("task").distinct().count() > 1


def test_formats_rendered_by_columns_are_what_messages_are():
    rng = random.Random(5)
    kinds = ("%d", "%5d|", "%-05d|", "%+d", "% i", "%.3d", "%u", "%+u", "%#x", "%#lX", "%08x", "%hhd", "%ho", "%f", "%08.2lf", "%-+9.1e|", "%#.0f", "%g", "%5.f", "%F", "%a", "%c", "%s", "%-8.3s|", "%*d", "%.*lf", "%*.*s", "%p", "100%% %ld %E %lu", "no argument")
    rows = []
    for fmt in kinds:
        site = Site(3, "f.cc", 1, fmt)
        rows += [(fmt, [argument(rng, f) for f in site.takes]) for _ in range(40)]
    rows += [("%f", [dict.fromkeys(ARG_TYPES) | {"d": v}]) for v in (0.125, float("nan"), -float("inf"), -0.0, 0.0)]
    rows += [("%d %s", [dict.fromkeys(ARG_TYPES) | {"i": 3}]), ("%s", [dict.fromkeys(ARG_TYPES) | {"b": b"raw"}]), ("%d", [dict.fromkeys(ARG_TYPES) | {"d": 2.0}])]
    rng.shuffle(rows)
    for part in (rows, rows[:1], [r for r in rows if r[0] == "%f"], []):
        args = pa.array([[], *[a for _, a in part]], pa.list_(pa.struct(ARG_TYPES)))[1:]
        assert rendered(pa.array([f for f, _ in part], pa.string()), args).to_pylist() == [Renderer(f)(a) for f, a in part]


@given(st.sampled_from(("%d", "%+5d", "%-8ld|", "%05hd", "%u", "% lu", "%x", "%012lX", "%#d", "%e", "%+08.2f", "%-9.3g|", "%#g")), st.one_of(st.integers(-(2**63), 2**64 - 1), st.floats()))
def test_converters_are_c_format(fmt, value):
    (m,) = specifiers(fmt)
    if isinstance(value, int) or m["conv"] in "egf":
        kind = Renderer(fmt).steps[0][2]
        assert converter(m, kind)(value) == c_format(m, kind, value, None, None)


def test_rendering_takes_only_formats_and_arguments_to_python(spark):
    e = catalogue.logview.events(spark, "/root/testdata/sf0.001").withColumn("wide", F.repeat(F.lit("x"), 100))
    d = catalogue.logview.dictionary(spark, catalogue.logview.executions(spark, "/root/testdata/sf0.001")).withColumn("fmt", F.replace("fmt", F.lit("%d"), F.lit("%4d")))
    plan = render.message(e, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython [run(fmt#" in plan
    assert render.message(e, d).where("message like 'Hello World #   _7' and wide is not null").count() > 0


def test_round_trip_where_times_do_not_tell_messages_apart(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    copies = events.crossJoin(spark.range(3).withColumnRenamed("id", "k")).selectExpr("event_id + k * 1000 as event_id", "ts", *[c for c in events.columns if c not in ("event_id", "ts")], "k")
    copies = copies.withColumn("ts", F.expr("if(k = 2, ts + interval '5' year, ts)")).drop("k")  # back by more than 56 bits of ns, too
    copies.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    columns = "thread_id, rdtsc, seq, message"
    found = sorted(tuple(r) for r in catalogue.QUERIES["binlog_roundtrip"](spark, str(tmp_path)).select(*columns.split(", ")).collect())
    assert len(found) == 3000 and found == sorted(con.execute(f"SELECT {columns} FROM ({catalogue.ORACLE_SQL['binlog_roundtrip']})").fetchall())
