"""Cycles, seconds and wall clock as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_seconds(cycles: Column, cps: Column) -> Column:
    return cycles.cast("double") / cps


def from_seconds(seconds: Column, cps: Column) -> Column:
    return F.floor(seconds * cps + 0.5).cast("long")


def to_nanoseconds(cycles: Column, cps: Column) -> Column:
    return F.floor(F.lit(1e9) * cycles.cast("double") / cps + 0.5).cast("long")


def to_microseconds(cycles: Column, cps: Column) -> Column:
    return F.floor(to_nanoseconds(cycles, cps) / 1000).cast("long")


def from_nanoseconds(nanos: Column, cps: Column) -> Column:
    return F.floor(nanos.cast("double") * cps / F.lit(1e9) + 0.5).cast("long")


def wall_clock(rdtsc: Column, ckpt_rdtsc: Column, unix_time: Column, cps: Column) -> tuple[Column, Column]:
    """Epoch seconds and nanoseconds: whole seconds towards zero, and one borrowed for events before the checkpoint."""
    passed = (rdtsc - ckpt_rdtsc).cast("double") / cps
    whole = passed.cast("long")
    nanos = F.rint(F.lit(1e9) * (passed - whole.cast("double"))).cast("long")
    return unix_time + whole - F.when(nanos < 0, 1).otherwise(0), nanos + F.when(nanos < 0, 1_000_000_000).otherwise(0)


def rendered_time(seconds: Column, nanos: Column) -> Column:
    """In the session's time zone, nanoseconds with nine digits."""
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.format_string("%09d", nanos))
