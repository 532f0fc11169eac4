"""Connected components of an edge table.

Edges are first contracted within partitions of about ``PARTITION_EDGES``,
dealt by a hash of both ends, so that a hub's edges spread: a partition gives a
spanning forest of its edges, as stars around each tree's smallest node.  Where one such partition holds all edges that is the result; else
alternating large-star and small-star steps (joins and aggregations) finish
it.  No component is gathered anywhere unless all edges fit one partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuemarts.llm.common import Scratch

PARTITION_EDGES = 2_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) edges of a partition -> (node, smallest node of its tree)."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    u, v = at.reshape(2, -1)
    low = np.arange(len(nodes))
    while True:                               # hook to the smaller root, then halve paths
        a, b = low[u], low[v]
        if (a == b).all():
            break
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]
    own = np.flatnonzero(low != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[low[own]])], ["u", "v"])


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return tuple(r)


def components(edges: DataFrame, scratch: Scratch, partition_edges: int = PARTITION_EDGES) -> DataFrame:
    """``edges`` (x, y) -> (node, component): the smallest node of its
    component, for every node of an edge between different nodes."""
    e = edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    parts = max(1, -(-e.count() // partition_edges))
    # dealt by both ends: the links of a hub spread over all partitions
    e = scratch.write(e.repartition(parts, "u", "v").mapInArrow(_forest, "u bigint, v bigint"), "forest")
    mark = _mark(e) if parts > 1 else (0,)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that Spark can split the join at a hub
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        e = scratch.write(small, "stars")
        new = _mark(e)
        if new == mark:
            break
        mark = new
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
