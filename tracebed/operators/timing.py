"""Times between messages: deltas, their reverse distribution, traces of several threads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FILE_ORDER

RING = 8192


def deltas(events: DataFrame, within: tuple[str, ...] = ("file", "execution_id", "thread_id")) -> DataFrame:
    """Cycles since the message before in file order, in each thread of an execution (within=("file",): in the file).

    An extent, of one thread and a megabyte at most, is what a task sorts; the first message of each takes the last of the
    extent before, which is found among a row for each extent."""
    extent = list(FILE_ORDER[:3])
    last = events.groupBy(*dict.fromkeys([*extent, *within])).agg(F.max_by("rdtsc", "seq").alias("__last"))
    order = Window.partitionBy(*within).orderBy(*[c for c in extent if c not in within])
    before = last.select(*extent, F.lag("__last").over(order).alias("__before"))
    inside = Window.partitionBy(*extent).orderBy("seq")
    both = events.withColumn("__own", F.lag("rdtsc").over(inside)).join(before, extent)
    return both.withColumn("delta", F.col("rdtsc") - F.coalesce("__own", "__before")).where("delta is not null").drop("__own", "__before")


def rcdf(d: DataFrame, cps: float = 1e9) -> DataFrame:
    """cycles, fraction: for each value the share of deltas that are larger; the smallest with 1, the largest with 1/n.

    Equal deltas are counted first, and the running sum goes over those counts, in ranges of values: sums of ranges
    first, then within each range, so no task needs all of them. Above 5 GHz values closer than the bound are joined
    by the greedy walk, which is sequential, over the counts."""
    counts = d.groupBy(F.col("delta").alias("cycles")).agg(F.count("*").alias("n"))
    bound = int(1e-10 * cps + 0.5)
    if bound:
        return counts.groupBy().applyInPandas(lambda pdf: walk(pdf, bound), "cycles bigint, fraction double, point string")
    counts = counts.withColumn("range", F.shiftright("cycles", 20))
    sums = counts.groupBy("range").agg(F.sum("n").alias("s"), F.max("cycles").alias("top"), F.min("cycles").alias("low"))
    over = Window.orderBy("range")
    sums = sums.select("range", (F.sum("s").over(over) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy()).alias("all"), F.max("top").over(Window.partitionBy()).alias("last"), F.min("low").over(Window.partitionBy()).alias("first"))
    here = Window.partitionBy("range").orderBy("cycles")
    df = counts.join(sums, "range").withColumn("upto", F.col("before") + F.sum("n").over(here))
    inner = df.where("cycles < last").select("cycles", (1 - F.col("upto").cast("double") / F.col("all")).alias("fraction"), F.lit("inner").alias("point"))
    first = df.where("cycles = first").select("cycles", F.lit(1.0).alias("fraction"), F.lit("first").alias("point"))
    last = df.where("cycles = last").select("cycles", (F.lit(1.0) / F.col("all")).alias("fraction"), F.lit("last").alias("point"))
    return first.unionByName(inner).unionByName(last)


def walk(pdf: pd.DataFrame, bound: int) -> pd.DataFrame:
    pdf = pdf.sort_values("cycles")
    values, n = pdf["cycles"].tolist(), int(pdf["n"].sum())
    if not n:
        return pd.DataFrame({"cycles": [], "fraction": [], "point": []})
    out, shown, before = [(values[0], 1.0, "first")], values[0], 0
    for v, count in zip(values, pdf["n"].tolist(), strict=True):
        if v - shown > bound:
            out.append((shown, 1 - before / n, "inner"))
            shown = v
        before += count
    out.append((values[-1], 1 / n, "last"))
    return pd.DataFrame(out, columns=["cycles", "fraction", "point"])


def rcdf_mean(d: DataFrame) -> DataFrame:
    """As the report prints it: the sum leaves out the smallest delta, the count does not."""
    return d.agg(F.count("*").alias("n"), F.expr("(sum(delta) - min(delta)) div nullif(count(*), 0)").alias("mean_cycles"))


def trace(records: DataFrame, cps: Column | None = None) -> DataFrame:
    """records: buffer_idx, slot, timestamp, fmt, arg0 .. arg3. Threads' rings, merged by time.

    Of each buffer the last 8191 records; then those from the latest of the buffers' oldest times on; ns since that
    time, and since the record before."""
    cps = F.lit(1e9) if cps is None else cps
    recent = Window.partitionBy("buffer_idx").orderBy(F.col("slot").desc())
    kept = records.withColumn("__n", F.row_number().over(recent)).where(F.col("__n") < RING).drop("__n")
    start = kept.groupBy("buffer_idx").agg(F.min("timestamp").alias("oldest")).agg(F.max("oldest").alias("start"))
    df = kept.crossJoin(F.broadcast(start)).where("timestamp >= start")
    df = df.withColumn("ns", (F.col("timestamp") - F.col("start")).cast("double") / cps * 1e9)
    # Rings bound what is merged: 8191 records a thread.
    order = Window.orderBy("timestamp", "buffer_idx", "slot")
    return df.withColumn("delta_ns", F.col("ns") - F.lag("ns", 1, 0.0).over(order)).withColumn("position", (F.row_number().over(order) - 1).cast("long"))
