"""Quality rules: a decision list learned from labelled statistics, run as one ordered Spark conditional.

Statistics of every whole text are DataFrame expressions; no Python runs on executors. Learning is sequential covering
on at most `sample` labelled rows (a bound that does not follow the corpus), the rows with the smallest hashes of their
doc_id: each rule for poor documents is grown on two thirds of them by information gain, pruned on the last third,
kept while it is right often enough, and what it covers is taken off before the next.

Nulls: a null text has no words and fails the base rule; null labels are left out; null doc_ids keep their row.
Repeated rows each give a row; with no labels, or of one kind only, the list is empty and the base rule decides alone.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD

#: Ratios on which rules may set thresholds.
MEASURES = {
    "symbol_ratio": "n_symbols / n_words",
    "dup_line_ratio": "n_dup_lines / n_lines",
    "repeat_ratio": "n_repeat_words / n_words",
    "distinct_ratio": "n_distinct / n_words",
    "word_length": "word_chars / n_words",
    "capital_ratio": "n_capitals / word_chars",
    "mark_ratio": "n_marks / n_words",
    "words": "n_words",
}
Rule = list[tuple[str, str, float]]  # conjunction of (measure, "<=" or ">", threshold)


def statistics(docs: DataFrame, window: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and counts of each whole text; carry: more columns to keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("__t"), *carry)
    df = df.withColumn("__w", F.transform(F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    df = df.withColumn("__lines", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("__w")
    hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(window)]))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("__h", F.when(n < window, none).otherwise(hashes))
    # Only texts that repeat a window pay for the sort that finds where.
    pairs = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) == F.size("__h"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(pairs))
    twice = lambda x, j: (x["h"] == F.get(F.col("__s"), j - 1)["h"]) | (x["h"] == F.get(F.col("__s"), j + 1)["h"])
    starts = F.array_sort(F.transform(F.filter("__s", lambda x, j: F.coalesce(twice(x, j), F.lit(False))), lambda x: x["i"]))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(starts, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n")), lambda a: a["n"])
    count = lambda pattern: F.regexp_count("__t", F.lit(pattern)).cast("long")
    return df.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        (F.length("__t") - count(r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__s") == 0, F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        count("[A-Z]").alias("n_capitals"),
        count("[.,;:!?]").alias("n_marks"),
        *carry,
    )


def measured(stats: DataFrame) -> DataFrame:
    out = stats
    for name, ratio in MEASURES.items():
        top, _, bottom = ratio.partition(" / ")
        out = out.withColumn(name, F.coalesce(F.expr(f"cast({top} as double) / nullif({bottom}, 0)" if bottom else f"cast({top} as double)"), F.lit(0.0)))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    hit = np.ones(len(next(iter(x.values()))), bool)
    for name, side, at in rule:
        hit &= (x[name] <= at) if side == "<=" else (x[name] > at)
    return hit


def grow(x: dict[str, np.ndarray], poor: np.ndarray, longest: int) -> Rule:
    """Adds the threshold of most information gain until only poor rows are covered."""
    rule, hit = [], np.ones(len(poor), bool)
    while len(rule) < longest and hit.any() and not poor[hit].all():
        p0, n0 = poor[hit].sum(), hit.sum()
        if not p0:
            break
        best = (1e-9, None)
        for name, values in x.items():
            v, y = values[hit], poor[hit]
            order = np.argsort(v, kind="stable")
            v, seen = v[order], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            low_p, low_n = seen[cut], cut + 1
            for side, p, n in (("<=", low_p, low_n), (">", p0 - low_p, n0 - low_n)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - math.log2(p0 / n0)), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, side, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        hit &= covers([best[1]], x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], poor: np.ndarray) -> Rule:
    """The shortest prefix of the rule that is worth most on rows it was not grown on."""
    worth = lambda r: (lambda h: (poor[h].sum() - (~poor)[h].sum()) / max(1, h.sum()))(covers(r, x))
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn(rows: list[tuple], names: list[str], precision: float = 0.9, most: int = 16, longest: int = 4) -> list[Rule]:
    """rows: the measures, then whether the row is poor, in an order that has nothing to do with either."""
    if not rows:
        return []
    data = np.array([[float(v) for v in r] for r in rows])
    x, poor = {n: data[:, i] for i, n in enumerate(names)}, data[:, -1] > 0.5
    rules, left = [], np.ones(len(poor), bool)
    held = np.arange(len(poor)) % 3 == 2
    while len(rules) < most and poor[left].any() and not poor[left].all():
        on, off = left & ~held, left & held
        pick = lambda m: {n: v[m] for n, v in x.items()}
        rule = grow(pick(on), poor[on], longest)
        if not rule:
            break
        if off.any():
            rule = prune(rule, pick(off), poor[off])
        hit = left & covers(rule, x)
        if hit.sum() < 3 or poor[hit].mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects; the rules are asked in order."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for name, side, at in rule:
            test = test & ((F.col(name) <= F.lit(at)) if side == "<=" else (F.col(name) > F.lit(at)))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> list[Rule]:
    """Only the sampled rows are measured; their doc_ids, at most `sample`, are what the join broadcasts."""
    marked = labels.where("quality is not null and doc_id is not null").select("doc_id", (F.col("quality") == 0).cast("int").alias("poor"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "poor").limit(sample)
    rows = measured(statistics(docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id"), carry=("poor",)))
    return learn([tuple(r) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "poor").select(*MEASURES, "poor").limit(sample).collect()], list(MEASURES))


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    # What is not deterministic keeps a filter on `kept` above the statistics; pushed below, it would repeat them for each use.
    out = measured(stats.withColumn("__at", F.monotonically_increasing_id())).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules) & (F.col("__at") >= 0)).drop("__at")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that neither the base rule nor the learned list rejects."""
    rules, columns = train(docs, labels), docs.columns
    stats = statistics(docs.withColumn("__row", F.struct(*columns)), carry=("__row",))
    return judged(stats, rules).where("kept").select(*[F.col("__row")[c].alias(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(statistics(docs), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the base rule alone, which SQL can express."""
    stats = statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"))


BASE_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, list_slice(w, i, i + 4) AS win FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1),
k AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM c) GROUP BY r),
s AS (SELECT d.*, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words,
    len(w) < 10 OR 100 * coalesce(k.n, 0) > 20 * len(w) AS base_failed
FROM s LEFT JOIN k USING (r)
"""
