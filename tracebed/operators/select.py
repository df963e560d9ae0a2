"""Filters, dictionary search, and orders."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fmt import log_id_key, signature
from ..schema import DEBUG, FILE_ORDER, KEY, NOTICE, TIME_ORDER
from .render import small, with_dictionary

BUFFERED = 3  # stages that a merge holds


def by_severity(events: DataFrame, dictionary: DataFrame, level: int | None = None) -> DataFrame:
    """Messages at least as severe as level, which is clamped to the known ones; level 0 keeps none. Without one the
    session's level holds (engine.set_log_level)."""
    if level is None:
        level = int(events.sparkSession.conf.get("spark.tracebed.level", str(NOTICE)))
    keep = dictionary.where(F.col("severity") <= max(0, min(DEBUG, level))).where("severity > 0")
    return with_dictionary(events, keep.select(*KEY, "severity"))


def by_id(events: DataFrame, log_id: int) -> DataFrame:
    if not isinstance(log_id, int) or log_id < 0:
        raise ValueError(f"Invalid logId: {log_id}")
    return events.where(F.col("log_id") == log_id)


def find(dictionary: DataFrame, needle: str) -> DataFrame:
    """Statements whose format contains the needle, by case; an empty needle finds all. Events are not touched."""
    return dictionary.where(F.contains(F.col("fmt"), F.lit(needle))).select("log_id", "filename", "line", "fmt")


def unknown(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Messages without a statement: none, in a sound log."""
    return with_dictionary(events, dictionary.select(*KEY), "left_anti")


def numbered(dictionary: DataFrame) -> DataFrame:
    """Statements by canonical id: the rank of their name."""
    key = F.udf(log_id_key, "string")  # once for each statement, not for each message
    return dictionary.withColumn("key", key("fmt", "filename", "line")).withColumn("canonical_id", (F.row_number().over(Window.orderBy("key")) - 1).cast("long"))


def signatures(dictionary: DataFrame) -> DataFrame:
    """How many statements take each list of argument types."""
    return dictionary.where("valid").withColumn("signature", F.udf(signature, "string")("fmt")).groupBy("signature").agg(F.count("*").alias("statements"))


def merged(maps: list[DataFrame], key: str = "log_id") -> DataFrame:
    """Statements of several maps; of one key the later map's wins."""
    tagged = [m.withColumn("__map", F.lit(i)) for i, m in enumerate(maps)]
    out = tagged[0]
    for m in tagged[1:]:
        out = out.unionByName(m)
    rest = [c for c in out.columns if c not in (key, "__map")]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "__map").alias("r")).select(key, *[F.col(f"r.{c}") for c in rest])


def in_file_order(events: DataFrame) -> DataFrame:
    return events.orderBy(*FILE_ORDER)


def in_time_order(events: DataFrame, bounded: bool = False, source: DataFrame | None = None) -> DataFrame:
    """By time within executions. bounded: as a merge of three buffered stages gives it, which differs only for executions
    with a message that is more than two stages late, or earlier than the one before it in its extent; these are looked for
    first, in source if events are costly to make."""
    if not bounded or (uneven := out_of_order(events if source is None else source)).isEmpty():
        return events.orderBy(*TIME_ORDER)
    near = [c for c in TIME_ORDER if c not in KEY[:2]]
    even = events.join(small(uneven), list(KEY[:2]), "left_anti").withColumn("__at", F.lit(0).cast("long"))
    merged = merged_stages(events.join(small(uneven), list(KEY[:2]), "left_semi"))
    return even.unionByName(merged).orderBy(*KEY[:2], "__at", *near).drop("__at")


def positions(events: DataFrame, bits: int = 30) -> DataFrame:
    """Adds `position`, from 1, of each message in the order of time of its execution. Messages are counted by ranges of
    2**bits cycles first, so a task sorts a range of an execution and not all of it."""
    ranged = events.withColumn("__range", F.shiftright("rdtsc", bits))
    counts = ranged.groupBy(*KEY[:2], "__range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*KEY[:2]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(*KEY[:2], "__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__ahead"))
    here = Window.partitionBy(*KEY[:2], "__range").orderBy(*[c for c in TIME_ORDER if c not in KEY[:2]])
    placed = ranged.join(small(ahead), [*KEY[:2], "__range"])
    return placed.withColumn("position", (F.row_number().over(here) + F.col("__ahead")).cast("long")).drop("__range", "__ahead")


def out_of_order(events: DataFrame) -> DataFrame:
    """The executions that a merge of three stages does not bring into the order of time. Stages are first summed up each,
    so what a window sorts is a row for each stage and not for each message."""
    extent = Window.partitionBy(*KEY[:2], "extent_id").orderBy("seq")
    back = F.coalesce(F.col("rdtsc") < F.lag("rdtsc").over(extent), F.lit(False))
    stages = events.select(*KEY[:2], "stage_id", "rdtsc", back.alias("back")).groupBy(*KEY[:2], "stage_id").agg(F.min("rdtsc").alias("low"), F.max("rdtsc").alias("high"), F.max("back").alias("back"))
    before = Window.partitionBy(*KEY[:2]).orderBy("stage_id").rowsBetween(Window.unboundedPreceding, -BUFFERED)
    return stages.withColumn("sent", F.max("high").over(before)).where((F.col("low") < F.col("sent")) | F.col("back")).select(*KEY[:2]).distinct()


class Merge:
    """A merge of at most three stages that are held at once. Each has its extents in a heap, by the time of their next
    message; of equal times the lower stage comes first, and in it the lower extent."""

    def __init__(self) -> None:
        self.held: list[list[tuple]] = []

    def add(self, extents: dict[int, list[tuple]]) -> Iterator[object]:
        """A stage: extents of (time, what) in their order. Gives what goes out before another stage can be taken."""
        heap = [(rows[0][0], name, 0, rows) for name, rows in extents.items() if rows]
        heapify(heap)
        self.held.append(heap)
        if len(self.held) == BUFFERED:
            yield from self.drain(once=True)

    def drain(self, once: bool = False) -> Iterator[object]:
        while any(self.held):
            _, k = min((heap[0][0], k) for k, heap in enumerate(self.held) if heap)
            heap = self.held[k]
            _, name, at, rows = heap[0]
            yield rows[at][1]
            if at + 1 < len(rows):
                heapreplace(heap, (rows[at + 1][0], name, at + 1, rows))
            else:
                heappop(heap)
            if not self.held[0]:
                self.held.pop(0)
                if once:
                    return
        self.held.clear()


def merge_stages(rows: list[tuple[int, int, int, int]]) -> list[int]:
    """Indexes of (stage, extent, seq, time) in the order of the merge."""
    out, merge, stages = [], Merge(), defaultdict(lambda: defaultdict(list))
    for i in sorted(range(len(rows)), key=lambda i: rows[i][:3]):
        stages[rows[i][0]][rows[i][1]].append((rows[i][3], i))
    for stage in sorted(stages):
        out += merge.add(stages[stage])
    return [*out, *merge.drain()]


def merged_stages(events: DataFrame) -> DataFrame:
    """events with __at, their place in the merge of their execution. Executions are streamed, stage after stage, so a task
    holds three stages of one execution; the merge itself is sequential, as each stage waits for the third before it."""
    schema = T.StructType([*events.schema.fields, T.StructField("__at", T.LongType())])
    names = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, here, stage, extents, at, out = Merge(), None, None, defaultdict(list), 0, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            wide = pa.Table.from_batches([r for r, _, _ in rows]) if rows else None
            return wide.append_column("__at", pa.array([p for _, _, p in rows], pa.int64())).combine_chunks().to_batches()[0]

        def take(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal at, out
            for row in found:
                out.append((row[0], row[1], at))
                at += 1
                if len(out) == 4096:
                    yield batch_of(out)
                    out = []

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*KEY[:2], "stage_id", "extent_id", "rdtsc")]
            for i, (file, execution, own, extent, time) in enumerate(zip(*columns, strict=True)):
                if ((file, execution), own) != (here, stage):
                    if extents:
                        yield from take(merge.add(extents))
                        extents = defaultdict(list)
                    if (file, execution) != here:
                        yield from take(merge.drain())
                        at = 0
                    here, stage = (file, execution), own
                extents[extent].append((time, (batch.slice(i, 1), i)))
        if extents:
            yield from take(merge.add(extents))
        yield from take(merge.drain())
        if out:
            yield batch_of(out)

    return events.repartition(*KEY[:2]).sortWithinPartitions(*FILE_ORDER[:2], "stage_id", "extent_id", "seq").select(*names).mapInArrow(run, schema)
