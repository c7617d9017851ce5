"""Connected components by alternating large-star and small-star steps; each step is written, none is collected."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import spread, unwritten, written

#: Steps double the reach of labels; this many cover any graph that fits a cluster, and more are an error.
MOST_STEPS = 60
#: Up to this many edges (16 bytes each) are joined in one task, as the jobs of the steps would take longer than that.
ONE_TASK = 100_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = top(u), top(v)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for every node of edges(u, v). Loops and copies are fine."""
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = written(pairs, "edges")
    if pairs.count() <= ONE_TASK:
        labels = written(pairs.coalesce(1).mapInArrow(_joined, "node long, label long"), "labels")
        unwritten(pairs)
        return labels
    before = None
    for _ in range(MOST_STEPS):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.where("m < u").select("u", F.col("m").alias("v"))
        large = large.union(own).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        given, pairs = pairs, written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        unwritten(given)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components aren't found after {MOST_STEPS} steps")
    # At the fixpoint every node but the smallest points at the smallest.
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
