"""Connected components of an edge table, by alternating large and small stars.

Each round is a few equi-joins and minimum aggregations.  Minima are taken before
the shuffle, and the edges of a hub, a node with more than a small share of all
edges, are never dealt out by it: the least neighbours of hubs, a bounded number,
are broadcast to them.  Rounds end when the edges are stars around the smallest
node of each component and no longer change, or when at most ``LOCAL_EDGES`` are
left, a number that one task settles at once.  Every round's edges are written
to the shared folder, which also cuts the lineage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import join_hot, materialize

#: Edges that one task may hold (some 16 MB); more go through rounds of stars.
LOCAL_EDGES = 500_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, ascending, and the least node that each can reach."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in ends.reshape(2, -1).T.tolist():
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for x in range(len(parent)):  # a parent is smaller, so it is settled already
        parent[x] = parent[parent[x]]
    return nodes, nodes[parent] if len(nodes) else nodes


def _settle(batches):
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if parts:
        nodes, least = least_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        moved = nodes != least
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(least[moved])], ["a", "b"])


def _mark(edges: DataFrame) -> tuple:
    """A digest of the edge set, whose rows are distinct."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour and number of edges."""
    return materialize(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("edges")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    told = join_hot(both, _least(both), ["a"], "edges").withColumn("m", F.least("a", "m"))
    return told.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = join_hot(edges, least, ["a"], "edges").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)`` that is not its component's smallest.

    Nodes are integers; null ends and loops are left out; an edge may repeat and
    stand in either direction; an empty table gives an empty result.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        if mark[0] <= LOCAL_EDGES:
            now = materialize(now.coalesce(1).mapInArrow(_settle, "a long, b long"), "components")
            break
        now = materialize(_small_star(_large_star(now)), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
