"""Connected components of an edge list by alternating large-star and small-star steps.

The steps contract the graph until it is done, or small: up to LOCAL_EDGES edges, which one task holds with ease, the rest is
a union of sets there. No more than that ever meets in a task, whatever the size of a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlytics.sources.stage import materialise

LOCAL_EDGES = 250_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per node of an edge: node, root (the smallest node of its component).

    Minima are taken with partial groups, so a node with many neighbours is one row for each task; the edges of each step
    are written to the shared folder. Loops and repeated edges change nothing. No edges give no rows.
    """
    e = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while e.count() > LOCAL_EDGES:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        e = materialise(small)
        roots = e.select(F.col("v").alias("u")).distinct()
        open_ = e.join(roots, "u", "left_semi").select("u").unionAll(e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u"))
        if open_.isEmpty():  # every node has one edge, to a root
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select("u", "u"))
    return e.coalesce(1).mapInArrow(_united, "node long, root long")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots of at most LOCAL_EDGES edges by union of sets, the smaller node on top."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            low, high = sorted((root(u), root(v)))
            parent[high] = low
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])
