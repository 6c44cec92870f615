"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdex.llm.common import carry_back, cut


#: Edges that one task solves by union-find, 4 MB; in rounds over more edges, those of a partition at least.
PER_PARTITION = 250_000


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of the nodes of all edges of a task."""
    edges = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if b.num_rows]
    if not edges:
        return
    node, at = np.unique(np.concatenate(edges), return_inverse=True)
    up = list(range(len(node)))
    for a, b in at.reshape(-1, 2).tolist():
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        up[max(a, b)] = min(a, b)
    for i, x in enumerate(up):  # a parent is less than its child, so it's final already
        up[i] = up[x]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[up])], names=["node", "label"])


def _hang(rows: DataFrame, key: str, least: str, n: int) -> DataFrame:
    """rows of a star, each with m, the least `least` of its key; a hub's rows are spread, as its m comes by broadcast."""
    of = rows.groupBy(key).agg(F.min(least).alias("m"), F.count("*").alias("k"))
    return carry_back(rows, of, key, "k", n).drop("k")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of the edges (a, b); the label is the least node of its component.

    Edges may repeat, point either way or be loops; nulls are left out. Each round hangs every neighbour on the least node it
    knows, in joins and aggregations over the edge table, and is written to the shared folder; the edges of a long path
    shorten by a constant factor in each round. Counts combine on the map side, and what a node with over 1/1000 of the
    edges learns is broadcast to them. Nothing but an edge count and checksum comes to the driver. Up to PER_PARTITION edges
    are solved in one task instead, with the same labels.
    """
    e = cut(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, before = e.count(), None
    if n <= PER_PARTITION:
        return cut(e.coalesce(1).mapInArrow(_solve, "node bigint, label bigint"))
    while True:
        parts = max(8, n // max(PER_PARTITION, 1)) if PER_PARTITION else 8  # rounds over few edges write few files
        e = e.coalesce(parts)
        both = e.union(e.select("b", "a").toDF("a", "b"))
        large = _hang(both, "a", "b", 2 * n).select("b", "a", F.least("a", "m").alias("m")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = cut(large.distinct().coalesce(parts))
        small = _hang(large, "a", "b", n)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m")).filter("a <> b")
        e = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(parts))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select("b", "b").distinct())
        n, before = now[0], now
