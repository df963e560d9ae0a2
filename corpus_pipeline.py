"""The corpus pipeline: five stages, each over all that the one before has kept, written and read again between them."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tracebed.llm import decontaminate, mixing, quality, simhash, tokens
from tracebed.llm.common import MADE, drop, written

#: Scratch tables of the stage that a thread ran last. What it returned has been written since, so the next stage drops
#: them; those of the last stage stay, as its frame reads them.
LEFT: dict[int, list[str]] = {}


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = LEFT.pop(threading.get_ident(), [])
        if fn.__name__ != "quality_rules":  # the first
            drop(spark, *left)
        before = set(MADE)
        out = fn(spark, docs, sf_dir)
        LEFT[threading.get_ident()] = [p for p in MADE if p not in before]
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8; by fingerprints, then exactly) the smallest doc_id stays."""
    return simhash.one_of_each(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source is taken up to its target: a row for each epoch of a document."""
    return mixing.materialise(docs)


@stage
def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids at permuted slots in shards of fixed stride; a row for each slot, read back."""
    return tokens.read(*tokens.shards(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_shards),
]

#: The learned rules, near copies and token ids are not for SQL; tests/llm/test_pipeline.py holds every stage and the run as
#: a whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, fn in STAGES[:-1]:
        docs = written(fn(spark, docs, sf_dir), name.split()[0])
        if last is not None:
            drop(spark, last)
        last = docs._table
    return STAGES[-1][1](spark, docs, sf_dir)
