"""Streams of messages: ordered release with a bound on how late a stage may be, running counts, and sync."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.select import BUFFERED
from ..shared import shared

HELD = "execution_id int, rdtsc bigint, stage_id int, extent_id bigint, seq bigint, position bigint, late boolean"
COLUMNS = ["execution_id", "rdtsc", "stage_id", "extent_id", "seq"]
STATE = "rows array<struct<execution_id:int,rdtsc:bigint,stage_id:int,extent_id:bigint,seq:bigint>>, sent bigint, n bigint"


def release(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps an execution's last stages; older messages go out in order of time, numbered, and what comes later than one
    that has gone is marked late, however long ago that was.

    State is bounded by three stages of one execution, not by the stream. A pause in the stream sends the rest; two
    numbers stay for each execution: the latest time and the count of what was sent."""
    held, sent, n = (pd.DataFrame([list(r) for r in state.get[0]], columns=COLUMNS), *state.get[1:]) if state.exists else (pd.DataFrame([], columns=COLUMNS), -1, 0)
    if state.hasTimedOut:
        done, keep = held, held.iloc[:0]
    else:
        new = [b[COLUMNS] for b in batches]
        held = pd.concat([held, *new], ignore_index=True) if len(held) else pd.concat(new, ignore_index=True)
        last = held["stage_id"].max() - BUFFERED
        done, keep = held[held["stage_id"] <= last], held[held["stage_id"] > last]
    late = done["rdtsc"] < sent
    state.update(([tuple(map(int, r)) for r in keep.itertuples(index=False)], int(max([sent, *done["rdtsc"]])), n + len(done)))
    if len(keep):
        state.setTimeoutDuration(1000)
    if len(done):
        yield done.assign(late=late).sort_values(["rdtsc", "stage_id", "extent_id", "seq"]).assign(position=range(n + 1, n + len(done) + 1))[[c.split()[0] for c in HELD.split(", ")]]


def ordered_stream(events: DataFrame) -> DataFrame:
    """A stream of HELD, each message once; none is dropped."""
    return events.select(*COLUMNS).groupBy("execution_id").applyInPandasWithState(release, HELD, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def sync(query: StreamingQuery) -> None:
    """Returns when all that was there has been processed; stops the query."""
    query.processAllAvailable()
    query.stop()


def sunk(spark: SparkSession, path: str) -> DataFrame | None:
    """What a stream of HELD has put into a folder so far."""
    try:
        return spark.read.schema(HELD).parquet(path)
    except AnalysisException:  # nothing yet
        return None


def drained(events: DataFrame, n: int, seconds: float = 120) -> DataFrame:
    """What ordered_stream gives of a source of n messages, the last stages too, which go when the source pauses."""
    spark = events.sparkSession
    out, marks = shared(spark, "ordered"), shared(spark, "offsets")
    query = ordered_stream(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(processingTime="500 milliseconds").start()
    began = time.time()
    try:  # a stream with timeouts always has another batch, so there is no end of it to wait for
        while (found := sunk(spark, out)) is None or found.count() < n:
            if query.exception():
                raise query.exception()
            if time.time() - began > seconds:
                raise TimeoutError(f"{n} messages did not come within {seconds} s")
            time.sleep(0.5)
    finally:
        query.stop()
    return found


def running_counts(spark: SparkSession, events: DataFrame, key: str) -> DataFrame:
    """Counts that every micro-batch updates; the state has a row for each key."""
    out, marks = shared(spark, "counts"), shared(spark, "offsets")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    counts = events.groupBy(key).agg(F.count("*").alias("n"))
    query = counts.writeStream.outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.parquet(out).groupBy(key).agg(F.max_by("n", "epoch").alias("n"))
