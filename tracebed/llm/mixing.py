"""Mixing sources to target weights.

Every document gets a hash-random key. The key's leading digits cut each source into ranges of equal share, 4096 or,
of a large input, as many as keep each near `RANGE_BYTES`; the ranges' sums give distributed prefix sums, and only
rows of one range are ever sorted together. Prefix sums are exact, so the number of ranges does not show. Each source is
cut at its exact budget, after as many whole epochs as the budget holds. Texts are measured where they are read; what is
shuffled, once, is a row of numbers for each document, and the same shuffle gives both the ranges' sums and the order.

Nulls: a null text has size 0, a null source is a source of its own and ranks last; all null doc_ids share one key, as
all repeats of a doc_id do. Repeated rows are separate documents; equal keys are ordered by doc_id, size and a hash of
the text, so that what ties are left are equal rows. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, identified, masked, parts

RANGE_BYTES = 256 << 20


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes: source, size. One row per source: its size, and the target that water-filling gives it.

    Sources are filled in the order in which they reach their limit of `most` times their size: with all limits
    below taken off, the level is what is left per unit of weight; the first source whose limit is above the
    level fixes it for the rest."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    all_, order = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    by = by.withColumn("w", w).withColumn("lim", most * F.col("source_size")).withColumn("r", F.col("lim").cast("double") / F.col("w"))
    fill = Window.orderBy("r", F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("lim").over(before), F.lit(0))).cast("double") / F.sum("w").over(after)
    by = by.withColumn("k", F.row_number().over(fill)).withColumn("level", level)
    first = F.min(F.when(F.col("level") < F.col("r"), F.col("k"))).over(all_)
    by = by.withColumn("first", first).withColumn("level", F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(all_))
    return by.select("source", "source_size", F.when(F.col("k") >= F.col("first"), F.col("level") * F.col("w")).otherwise(F.col("lim").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix:", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), for each document."""
    digits = len(f"{parts(docs, RANGE_BYTES, least=1 << 8):x}")  # hexadecimal digits of the key that name its range
    name = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    base = sized(docs).select("doc_id", "source", "size", F.md5(name).alias("key"), F.xxhash64("text").alias("mark"), *carry)
    base = base.withColumn("range", F.substring("key", 1, digits))
    # Both uses of `rows` order by all columns, so that neither is pruned and Spark runs the shuffle once.
    here = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "mark", *carry)
    upto = F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0))
    rows = base.withColumn("place", F.row_number().over(here)).withColumn("upto", upto)
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    sums = rows.groupBy("source", "range").agg(F.max_by("upto", "place").alias("size"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    plan = targets(sums, weights, most)
    ranges = ranges.join(plan, same(ranges, plan, "source")).select(ranges["source"], "range", "ahead", "source_size", "target")
    out = rows.join(ranges, same(rows, ranges, "source", "range")).drop(ranges["source"]).drop(ranges["range"])
    budget = F.floor("target")
    epochs = F.coalesce(F.expr("floor(target) div nullif(source_size, 0)"), F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("ahead") - (F.col("upto") - F.col("size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


def materialise(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document once per whole epoch, and the part of it that the budget cuts as its first words.

    The mix is worked out without texts; what is taken of a row comes back to it by file and row number."""
    own = masked(docs, "doc_id", "text", "source")
    named = identified(own)
    taken = mix(named, carry=("__file", "__row"), **options).where("taken > 0").select("__file", "__row", F.col("taken").alias("__taken"), F.col("size").alias("__size"))
    out = named.join(taken, ["__file", "__row"])
    copies = F.sequence(F.lit(1), F.expr("cast(ceil(__taken / __size) as int)"))
    out = out.withColumn("__copy", F.explode(copies))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), (F.col("__taken") % F.col("__size")).cast("int")), " ")
    text = F.when(F.col("__copy") <= F.expr("__taken div __size"), F.col("text")).otherwise(cut)
    return out.select(*[(text if c == "text" else F.col(c)).alias(c) for c in own.columns]).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH base AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s0),
s2 AS (SELECT *, 3 * source_size AS lim, CAST(3 * source_size AS DOUBLE) / w AS r FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY r, source NULLS LAST) AS k,
    CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, min(CASE WHEN level < r THEN k END) OVER () AS first FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN k >= first THEN max(CASE WHEN k = first THEN level END) OVER () * w ELSE CAST(lim AS DOUBLE) END AS target FROM s4),
b AS (SELECT base.*, s5.source_size, s5.target,
    coalesce(sum(size) OVER (PARTITION BY base.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    coalesce(CAST(floor(target) AS BIGINT) // nullif(source_size, 0), 0) AS epochs
    FROM base JOIN s5 ON base.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target,
    CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken FROM b
"""
