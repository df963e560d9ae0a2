"""spark.read.format("binlog"): executions, dictionary, extents and events of binary logs; and writers, of batches and streams.

Options of a reader: relation (events, dictionary, executions, extents; default events), path (a file or a folder),
columns (of events, as a list with commas), mode (FAILFAST or PERMISSIVE: a corrupt log is read up to the corruption),
pushdown (true: with spark.sql.python.filterPushdown.enabled, equality filters on execution_id and thread_id skip whole
extents, one on log_id skips messages before their arguments are made).

A file of up to `WHOLE` bytes is walked and decoded by one task; only the headers of larger ones are walked before, some
files at a time, to cut them at extents. Events leave a task as Arrow batches.
"""

from __future__ import annotations

import os
import pickle
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import astuple, dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.columnar import starts
from ..functions.fmt import Fragment, num_nibbles
from ..schema import DICTIONARY, EVENTS, EXECUTIONS, EXTENTS, LEVELS
from ..shared import shared
from .columns import ARG_TYPES, Plan, args_array, decoded, packed
from .wire import Execution, Extent, Site, checkpoint, dictionary_fragment, extent, message_header, walk

PER_PARTITION = 16 << 20
WHOLE = 64 << 20
ROWS = 8192  # of a batch


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:|/", path) else fs.FileSystem.from_uri(os.path.abspath(path))


def logs(path: str) -> dict[str, int]:
    """The files of a path and their sizes, in order of name."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return {path: info.size}
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"Unable to open file {path}")
    found = store.get_file_info(fs.FileSelector(at))
    return {f"{path.rstrip('/')}/{f.base_name}": f.size for f in sorted(found, key=lambda f: f.base_name) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and not f.base_name.endswith(".tmp")}


def walked(path: str, permissive: bool) -> tuple[list[Execution], list[Extent]]:
    store, at = opened(path)
    with store.open_input_file(at) as f:
        return walk(f, permissive)


@dataclass
class Part(InputPartition):
    """Extents of a file with the statements of their executions; without extents, the whole file."""

    path: str
    extents: list[Extent] | None = None
    sites: dict[int, list[Site]] | None = None


def cut_up(path: str, executions: list[Execution], extents: list[Extent], step: int | None = None) -> Iterator[Part]:
    held, size = [], 0
    for e in extents:
        held.append(e)
        size += e.length
        if size >= (step or PER_PARTITION):
            yield part_of(path, executions, held)
            held, size = [], 0
    if held:
        yield part_of(path, executions, held)


def restored(path: str, extents: list[tuple], sites: dict[int, list[tuple]]) -> Part:
    """A part from its plain values, which travel between tasks."""
    return Part(path, [Extent(*e) for e in extents], {k: [Site(*s[:4], [Fragment(*f) for f in s[4]], *s[5:]) for s in own] for k, own in sites.items()})


def part_of(path: str, executions: list[Execution], extents: list[Extent]) -> Part:
    return Part(path, extents, {e.execution_id: executions[e.execution_id].sites for e in extents})


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.relation = options.get("relation", "events")
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.equal: dict[str, int] = {}

    def partitions(self) -> list[InputPartition]:
        files = logs(self.options["path"])
        large = [p for p, size in files.items() if size > WHOLE and self.relation == "events"]
        out = [Part(p) for p in files if p not in set(large)]
        with ThreadPoolExecutor(16) as pool:
            for path, (executions, extents) in zip(large, pool.map(lambda p: walked(p, self.permissive), large), strict=True):
                out += cut_up(path, executions, [e for e in extents if self.wanted(e)])
        return out or [Part("")]

    def wanted(self, e: Extent) -> bool:
        return all(getattr(e, k) == v for k, v in self.equal.items() if k != "log_id")

    def read(self, partition: Part) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        if self.relation == "events":
            part = partition
            if part.extents is None:
                executions, extents = walked(part.path, self.permissive)
                part = part_of(part.path, executions, [e for e in extents if self.wanted(e)])
            yield from events(part, self.schema.fieldNames(), self.equal.get("log_id"))
            return
        names = self.schema.fieldNames()
        for row in self.rows(partition.path):
            yield tuple(row[n] for n in names)

    def rows(self, path: str) -> Iterator[dict]:
        executions, extents = walked(path, self.permissive)
        if self.relation == "extents":
            for e in extents:
                yield {"file": path, "execution_id": e.execution_id, "stage_id": e.stage_id, "extent_id": e.extent_id, "thread_id": e.thread_id, "offset": e.offset, "bytes": e.length}
            return
        for k, e in enumerate(executions):
            if self.relation == "executions":
                yield {"file": path, "execution_id": k, "ckpt_rdtsc": e.ckpt_rdtsc, "unix_time": e.unix_time, "cycles_per_second": e.cycles_per_second, "new_metadata_bytes": e.new_metadata_bytes, "total_metadata_entries": e.total_metadata_entries}
                continue
            for i, s in enumerate(e.sites):
                pieces = [(f.arg_type, f.dyn_width, f.dyn_prec, f.fragment) for f in s.fragments]
                yield {"file": path, "execution_id": k, "log_id": i, "filename": s.filename, "line": s.line, "severity": s.severity, "fmt": s.fmt, "num_nibbles": num_nibbles(s.fragments), "fragments": pieces, "valid": s.valid}


class PushingReader(Reader):
    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("execution_id",), ("thread_id",), ("log_id",)):
                self.equal[f.attribute[0]] = f.value
            else:
                yield f


COLUMN_TYPES = {"file": pa.string(), "execution_id": pa.int32(), "stage_id": pa.int32(), "extent_id": pa.int64(), "seq": pa.int32(), "thread_id": pa.int64(), "log_id": pa.int64(), "rdtsc": pa.int64()}


def events(part: Part, names: list[str], log_id: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of the named columns. Arguments are not unpacked into columns unless they are asked for."""
    held: dict[str, list[pa.Array]] = {n: [] for n in names}

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(held[n]) for n in names], names)

    store, at = opened(part.path)
    plans = {k: [Plan(s) for s in sites] for k, sites in part.sites.items()}
    rows = 0
    with store.open_input_file(at) as f:
        for e in part.extents:
            f.seek(e.offset)
            found = decoded(f.read(e.length), plans[e.execution_id], "args" in names, log_id)
            same = {"file": part.path, "execution_id": e.execution_id, "stage_id": e.stage_id, "extent_id": e.extent_id, "thread_id": e.thread_id}
            own = {"seq": found.seq, "log_id": found.ids, "rdtsc": found.times}
            for n in names:
                held[n].append(args_array(found, plans[e.execution_id]) if n == "args" else pa.array(own[n], COLUMN_TYPES[n]) if n in own else pa.repeat(pa.scalar(same[n], COLUMN_TYPES[n]), len(found.ids)))
            rows += len(found.ids)
            if rows >= ROWS:
                yield batch()
                held, rows = {n: [] for n in names}, 0
    if rows:
        yield batch()


class StreamReader(DataSourceStreamReader):
    """New files of a folder, and new whole extents of files that grow; the offset is a count of extents for each file.

    Files whose size has not changed are not read again for it."""

    def __init__(self, schema: StructType, options: dict):
        self.inner = Reader(schema, options | {"mode": "PERMISSIVE"})
        self.seen: dict[str, tuple[int, list[Execution], list[Extent]]] = {}

    def look(self, path: str, size: int | None = None) -> tuple[list[Execution], list[Extent]]:
        if path not in self.seen or size is not None and self.seen[path][0] != size:
            self.seen[path] = (-1 if size is None else size, *walked(path, True))
        return self.seen[path][1:]

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {p: len(self.look(p, size)[1]) for p, size in logs(self.inner.options["path"]).items() if size}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, n in end.items():
            if n > start.get(path, 0):
                executions, extents = self.look(path)
                out += cut_up(path, executions, extents[start.get(path, 0) : n])
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.inner.read(partition)


STEP = 4 << 20


def stream_files(spark: SparkSession, path: str, per_trigger: int, columns: list[str] | None = None) -> DataFrame:
    """A stream of the events (or the named columns of them) of whole logs in a folder that takes at most `per_trigger` files
    at a time: writers may run ahead of it, the rest waits in the folder. Files are found by Spark's file source; a task
    walks each, and all tasks decode a few MB of extents at a time, however few the files are."""
    files = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.binlog").load(path)
    schema = {c.split()[0]: c for c in re.split(r", (?=\w+ )", EVENTS)}
    names = columns or [*COLUMN_TYPES, "args"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                for part in cut_up(name, *walked(name, False), STEP):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(astuple(part))], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part"):
                yield from events(restored(*pickle.loads(part.as_py())), names)

    parts = files.select("path").mapInArrow(cut, "part binary").repartition(spark.sparkContext.defaultParallelism)
    return parts.mapInArrow(run, ", ".join(schema[n] for n in names))


@dataclass
class Written(WriterCommitMessage):
    path: str
    messages: int


WRITTEN = pa.schema({"thread_id": pa.int64(), "rdtsc": pa.int64(), "severity": pa.int32(), "filename": pa.string(), "line": pa.int64(), "fmt": pa.string(), "args": pa.list_(pa.struct(ARG_TYPES))})


def batches(rows: Iterator) -> Iterator[pa.RecordBatch]:
    while chunk := [r.asDict(recursive=True) for r in islice(rows, ROWS)]:
        yield pa.RecordBatch.from_pylist(chunk, WRITTEN)


def all_packed(known: list[Site], ids: np.ndarray, args: pa.ListArray) -> list[bytes]:
    """The packed arguments of each message, worked out a statement at a time."""
    begin, sizes = starts(args)
    out: list[bytes] = [b""] * len(ids)
    for k in np.unique(ids).tolist():
        rows, takes = np.flatnonzero(ids == k), len(known[k].takes)
        if (wrong := sizes[rows][sizes[rows] != takes]).size:
            raise ValueError(f"{known[k].fmt!r} takes {takes} arguments, not {'null' if wrong[0] < 0 else wrong[0]}")
        for r, data in zip(rows.tolist(), packed(known[k], args.values, begin[rows]), strict=True):
            out[r] = data
    return out


class Writer(DataSourceWriter):
    """Each task writes a log of its own: a checkpoint, the dictionary of its messages, then extents by thread.

    Rows: thread_id, rdtsc, severity, filename, line, fmt, args. Options: path, ckpt_rdtsc, unix_time,
    cycles_per_second, level (messages that are less severe are not written)."""

    def __init__(self, options: dict):
        self.options, self.least = options, int(options.get("level", len(LEVELS) - 1))

    def write(self, iterator: Iterator) -> Written:
        return self.save(batches(iterator))

    def save(self, found: Iterator[pa.RecordBatch]) -> Written:
        store, at = opened(self.options["path"])
        store.create_dir(at, recursive=True)
        path = f"{at}/part-{uuid.uuid4().hex}.binlog"
        with store.open_output_stream(f"{path}.tmp") as out:
            out.write(checkpoint(int(self.options.get("ckpt_rdtsc", 0)), int(self.options.get("unix_time", 0)), float(self.options.get("cycles_per_second", 1e9))))
            return Written(path, self.encode(found, out))

    def encode(self, found: Iterator[pa.RecordBatch], out) -> int:
        """Writes each extent when it is full; the number of messages."""
        sites: dict[tuple, int] = {}
        known: list[Site] = []
        held: dict[int, list[bytes]] = defaultdict(list)
        size: dict[int, int] = defaultdict(int)
        last: dict[int, int] = defaultdict(int)
        fresh, n = [], 0

        def flush(thread: int) -> None:
            nonlocal fresh
            if fresh:  # a message is never before its dictionary entry
                out.write(dictionary_fragment(fresh, len(known)))
                fresh = []
            out.write(extent(thread, b"".join(held.pop(thread)), True))
            size[thread] = last[thread] = 0

        for batch in found:
            level = batch.column("severity")
            if level.null_count:
                raise ValueError("a message has no severity")
            # Messages that are not severe enough go before their arguments are looked at.
            batch = batch.filter(pc.and_(pc.greater(level, 0), pc.less_equal(level, self.least)))
            ids = []
            for key in zip(*(batch.column(c).to_pylist() for c in ("severity", "filename", "line", "fmt")), strict=True):
                if key not in sites:
                    sites[key] = len(known)
                    known.append(Site(*key))
                    fresh.append(known[-1])
                ids.append(sites[key])
            for site, thread, at, data in zip(ids, batch.column("thread_id").to_pylist(), batch.column("rdtsc").to_pylist(), all_packed(known, np.array(ids, int), batch.column("args")), strict=True):
                if len(data) > 1 << 19:
                    raise ValueError(f"a message of {len(data)} bytes is over the limit of {1 << 19}")
                if size[thread] + len(data) + 16 > 1 << 19:
                    flush(thread)
                data = message_header(site, at, last[thread]) + data
                last[thread] = at
                held[thread].append(data)
                size[thread] += len(data)
            n += len(ids)
        for thread in list(held):
            flush(thread)
        return n

    def commit(self, messages: list[Written]) -> None:
        store, _ = opened(self.options["path"])
        for m in messages:
            if m is not None:
                store.move(f"{m.path}.tmp", m.path)

    def abort(self, messages: list[Written]) -> None:
        store, _ = opened(self.options["path"])
        for m in messages:
            if m is not None:
                store.delete_file(f"{m.path}.tmp")


class ArrowWriter(Writer, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.save(iterator)


class StreamWriter(DataSourceStreamWriter):
    """Each micro-batch adds whole logs. A marker file tells which batches are in; a batch that runs again replaces what a
    stopped commit has left of it, and adds nothing if it was in already."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator) -> Written:
        return Writer(self.options).write(iterator)

    def commit(self, messages: list[Written], batchId: int) -> None:  # noqa: N803
        store, at = opened(self.options["path"])
        mark, own = f"{at}/_batch-{batchId:012d}", f"batch-{batchId:012d}-"
        if store.get_file_info(mark).type == fs.FileType.File:
            self.abort(messages, batchId)
            return
        for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith(own):
                store.delete_file(f.path)
        for m in messages:
            if m is not None and m.messages:
                folder, _, name = m.path.rpartition("/")
                store.move(f"{m.path}.tmp", f"{folder}/{own}{name}")
            elif m is not None:
                store.delete_file(f"{m.path}.tmp")
        with store.open_output_stream(mark) as out:
            out.write(str(sum(m.messages for m in messages if m is not None)).encode())

    def abort(self, messages: list[Written], batchId: int) -> None:  # noqa: N803
        Writer(self.options).abort(messages)


class StreamArrowWriter(StreamWriter, DataSourceStreamArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Writer(self.options).save(iterator)


class BinlogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binlog"

    def schema(self) -> str:
        relation = self.options.get("relation", "events")
        full = {"events": EVENTS, "dictionary": DICTIONARY, "executions": EXECUTIONS, "extents": EXTENTS}[relation]
        if wanted := self.options.get("columns"):
            kinds = {m[1]: m[0] for m in re.finditer(r"(\w+) (?:array<.*>$|[\w()]+)", full)}
            return ", ".join(kinds[c.strip()] for c in wanted.split(","))
        return full

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = PushingReader if self.options.get("pushdown", "false") == "true" else Reader
        return kind(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArrowWriter(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return StreamArrowWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BinlogSource)


def scratch_log(rows, **options) -> str:
    """Writes rows as logs in a folder that driver and executors share; its path."""
    spark = rows.sparkSession
    register(spark)
    path = shared(spark, "log")
    rows.write.format("binlog").mode("append").options(path=path, **options).save()
    return path
