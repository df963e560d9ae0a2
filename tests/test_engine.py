"""The query catalogue against DuckDB, and operators on small logs."""

import io
import os
import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tracebed import cli, engine
from tracebed.operators import aggregate, render, select, timing
from tracebed.plans import catalogue
from tracebed.schema import TIME_ORDER
from tracebed.sources.statements import StatementError, c_string, maps, scan, statements
from tracebed.sources.wire import Site, checkpoint, dictionary_fragment, extent, message_header, packed_args
from tracebed.streaming.ordered import drained, release

SF = "/root/testdata/sf0.001"


def normal(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = normal(tuple(r) for r in df.select(*columns).collect())
    assert found == normal(duck.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bounded_merge_equals_sort_where_stages_overlap_little(spark):
    rows = [("f", 0, s, s * 2 + e, k, 0, 0, 100 * s + 10 * k + e) for s in range(5) for e in range(2) for k in range(4)]
    df = spark.createDataFrame(rows, "file string, execution_id int, stage_id int, extent_id bigint, seq int, thread_id bigint, log_id bigint, rdtsc bigint")
    assert [r.rdtsc for r in select.in_time_order(df, bounded=True).collect()] == [r.rdtsc for r in select.in_time_order(df).collect()]


def test_empty_log(spark):
    e = catalogue.logview.events(spark, SF).where("false")
    r = aggregate.min_max_mean(e, 0).first()
    assert (r.num_logs, r.matching, r["mean"]) == (0, 0, None)
    assert timing.rcdf(timing.deltas(e)).count() == 0
    with pytest.raises(ValueError):
        select.by_id(e, -1)


def test_rcdf_with_a_bound(spark):
    d = spark.createDataFrame([(x,) for x in (1, 1, 5, 6, 20)], "delta bigint")
    found = [(r.cycles, round(r.fraction, 6), r.point) for r in timing.rcdf(d, 2e10).orderBy("cycles", "point").collect()]
    # Values within 2 cycles of the last one shown are joined to it.
    assert found == [(1, 1.0, "first"), (1, 0.6, "inner"), (5, 0.2, "inner"), (20, 0.2, "last")]


def test_cli(spark, tmp_path):
    site = Site(3, "a.cc", 7, "Hello World # %d of %0.2lf%%")
    other = Site(1, "b.cc", 8, "Debug")
    body, last = b"", 0
    for t, v in ((10, 4), (30, -9), (60, 8)):
        body += message_header(0, t, last) + packed_args(site, [{"i": v}, {"d": 0.2}])
        last = t
    log = tmp_path / "x.binlog"
    log.write_bytes(checkpoint(0, 1, 1e9) + dictionary_fragment([site, other], 2) + extent(3, body) + extent(4, message_header(1, 20, 0)) + checkpoint(0, 5, 1e9) + dictionary_fragment([other], 1) + extent(1, message_header(0, 1, 0)))
    run = lambda *a: (out := io.StringIO(), cli.main(list(a), spark, out.write))
    out, code = run("decompress", str(log))
    lines = out.getvalue().split("\r\n")
    assert code == 0 and lines[0] == "1970-01-01 00:00:01.000000010 a.cc:7 NOTICE[3]: Hello World # 4 of 0.20%"
    assert lines[1].endswith("b.cc:8 ERROR[4]: Debug") and "# New execution started" in lines
    assert "# Decompression Complete after printing 5 log messages" in lines
    assert run("decompressUnordered", str(log))[0].getvalue().split("\r\n")[1].endswith("# -9 of 0.20%")
    assert " Debug" in run("find", str(log), "Debug")[0].getvalue() and "Hello" not in run("find", str(log), "debug")[0].getvalue()
    text = run("minMaxMean", str(log), "0")[0].getvalue()
    assert "Matching Logs: 4 (80.00%)" in text and "Total: 3" in text and "Mean: 0" in text
    assert run("minMaxMean", str(log), "x")[1] == 255 and run("rcdfTime", str(log))[1] == 0
    assert run("decompress")[1] == 1 and run("nonsense", str(log))[1] == 1
    (tmp_path / "none").write_bytes(b"")
    out, code = run("decompress", str(tmp_path / "none"))
    assert code == 1 and "Unable to open file" in out.getvalue()


def test_ordered_stream_loses_nothing(spark, tmp_path):
    src = tmp_path / "src"
    e = catalogue.logview.events(spark, SF).select("execution_id", "rdtsc", "stage_id", "extent_id", "seq")
    e.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    rows = drained(stream, e.count()).collect()
    assert len({r.seq for r in rows}) == len(rows) == e.count()
    by_execution = {}
    for r in sorted(rows, key=lambda r: r.position):
        by_execution.setdefault(r.execution_id, []).append(r)
    for own in by_execution.values():
        assert [r.position for r in own] == list(range(1, len(own) + 1))
        top = -1
        for r in own:  # whatever is behind the latest time that an earlier batch sent is late, and nothing else is out of order
            assert r.late or r.rdtsc >= top
            top = max(top, r.rdtsc)


def test_late_marks_survive_a_pause():
    class State:
        exists, hasTimedOut, value = False, False, None  # noqa: N815

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.exists, self.value = True, value

        def setTimeoutDuration(self, ms):  # noqa: N802
            pass

        def remove(self):
            self.exists = False

    state, frame = State(), lambda rows: pd.DataFrame(rows, columns=["execution_id", "rdtsc", "stage_id", "extent_id", "seq"])
    assert list(release((0,), iter([frame([(0, 100, 0, 0, 0)])]), state)) == []
    state.hasTimedOut = True
    (first,) = release((0,), iter([]), state)
    state.hasTimedOut = False
    assert first["late"].tolist() == [False] and list(release((0,), iter([frame([(0, 50, 1, 1, 0), (0, 200, 1, 1, 1)])]), state)) == []
    state.hasTimedOut = True
    (second,) = release((0,), iter([]), state)
    assert second["late"].tolist() == [True, False] and second["position"].tolist() == [2, 3]


def test_bounded_merge_of_late_messages(spark):
    rng = random.Random(8)
    rows = [("f", x, s, 4 * s + e, k, rng.randrange(60) + rng.choice((0, 20)) * s) for x in range(6) for s in range(7) for e in range(rng.randrange(1, 4)) for k in range(rng.randrange(4))]
    rows += [("f", 9, s, s, k, 100 * s + k) for s in range(5) for k in range(3)]
    df = spark.createDataFrame(rows, "file string, execution_id int, stage_id int, extent_id bigint, seq int, rdtsc bigint").repartition(3)
    assert {r.execution_id for r in select.out_of_order(df).collect()} == {x for x in range(6)}
    found = [tuple(r) for r in select.in_time_order(df, bounded=True).collect()]
    expected = []
    for x in (*range(6), 9):
        own = [r for r in rows if r[1] == x]
        expected += [own[i] for i in select.merge_stages([(r[2], r[3], r[4], r[5]) for r in own])]
    assert found == expected


def test_statements_of_sources(spark, tmp_path):
    text = """# 1 "a.cc"
int MYLOG(int); const char *s = "LOG(NOTICE, \\"no\\");";
LOG(NOTICE, "Hello %d, %s"
    " and \\"more\\"", f(1, (2)), v[3, 4]);
# 40 "b.h" 1
LOG ( ERROR , "x" ) ;
"""
    found = list(scan(text, "-", "LOG"))
    assert [(s.filename, s.line, s.level, s.fmt, s.arguments) for s in found] == [("a.cc", 2, "NOTICE", 'Hello %d, %s and \\"more\\"', ["f(1, (2))", "v[3, 4]"]), ("b.h", 40, "ERROR", "x", [])]
    for bad in ('LOG(NOTICE, "x"', 'LOG(NOTICE, "x") }', "LOG(NOTICE);", "LOG(NOTICE, fmt);"):
        with pytest.raises(StatementError):
            list(scan(bad, "-", "LOG"))
    assert c_string('"a" \n "b\\"c"') == 'ab\\"c' and c_string('"a", "b"') is None and c_string('"a') is None
    (tmp_path / "x.i").write_text(text)
    assert statements(spark, str(tmp_path / "x.i")).count() == 2
    for i, body in enumerate(('{"codes": {"a": 1, "b": {"x": 2}}}', '{"codes": {"b": 3}, "other": {"c": 4}}')):
        (tmp_path / f"{i}.json").write_text(body)
    assert {r.key: r.value for r in maps(spark, [str(tmp_path / f"{i}.json") for i in range(2)], "codes").collect()} == {"a": "1", "b": "3"}


def test_engine_switches(spark, tmp_path):
    engine.set_log_level(spark, 9)
    assert engine.get_log_level(spark) == 4
    engine.set_log_level(spark, 2)
    engine.set_log_file(spark, str(tmp_path / "logs"))
    rows = spark.sql("select 1L as thread_id, id as rdtsc, cast(id % 5 as int) as severity, 'f.cc' as filename, id % 5 as line, 'm' as fmt, cast(array() as array<struct<type:string>>) as args from range(50)")
    engine.write_log(rows)
    stats = engine.get_stats(spark, seconds=1.0).first()
    assert stats.events == 20 and stats.bytes_in == 20 * 16 and stats.ns_per_event == 5e7 and stats.ratio > stats.ratio_padded
    engine.write_log(rows, level=1)  # appended
    assert engine.get_stats(spark).first().events == 30
    out = []
    engine.print_config(spark, out.append)
    assert "level: WARNING" in out
    engine.preallocate()
    spark.conf.unset("spark.tracebed.level")
    (tmp_path / "file").write_text("")
    with pytest.raises(ValueError, match="Unable to open"):
        engine.set_log_file(spark, str(tmp_path / "file"))


def test_text_sink(spark, tmp_path):
    e, d, x = catalogue.log(spark, SF)
    lines = render.lines(e, d, x)
    assert render.write_text(lines, str(tmp_path / "text")) == 1000
    read = "".join(p.read_text(newline="") for p in sorted((tmp_path / "text" / "lines").glob("part-*"))) + "".join(p.read_text(newline="") for p in (tmp_path / "text" / "footer").glob("part-*"))
    assert read == "".join(render.text_lines(lines.orderBy(*TIME_ORDER)))
    assert render.write_text(lines.where("false"), str(tmp_path / "none")) == 0
