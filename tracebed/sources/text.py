"""Rendered logs as text: lines to aggregate, and a read that only counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_text of each line, of any length, without its line end."""
    return spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("line_text"))


def raw_read(spark: SparkSession, path: str) -> DataFrame:
    """How many lines and characters there are: what a reader costs that does nothing else."""
    return spark.read.text(path, lineSep="\n").agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("characters"))
