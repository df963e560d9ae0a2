"""Connected components of links between 64-bit nodes, by alternating large and small stars.

Every round keeps the links' components and turns them towards stars about each component's smallest node; the number
of rounds grows with the logarithm of the longest path. Minima are aggregated before they are shuffled, so a hub with
very many links costs no more than its rows; the join that hands a hub's minimum back is one that AQE splits.
Each round is written to the shared folder, so a lost executor costs a round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

FEW = 1 << 20


def large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest it knows."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them. Here b < a in every link."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    down = links.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each of n nodes that has a link, and the smallest node that links lead it to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def thinned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links between any nodes: each to the smallest that these links lead to."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    node, root = forest(at[: len(a)], at[len(a) :], len(nodes))
    return nodes[node], nodes[root]


def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.zeros((2, 0), np.int64)]
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("a", "b")]))
    node, root = thinned(*np.concatenate(held, axis=1))
    yield pa.RecordBatch.from_pydict({"node": node, "root": root})


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, root: the smallest node of its component, for each node that has a link to another.

    At most `FEW` links, 16 MB, are the work of one task on an executor; more go on in rounds."""
    links = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while links.count() > FEW:
        links = written(small_star(large_star(links)), "links", supersedes=links)
        # Sums of mixed hashes tell whether a round changed anything.
        mark = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
    return links.coalesce(1).mapInArrow(at_once, "node bigint, root bigint")
