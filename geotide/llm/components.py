"""Connected components of a large edge list: union-find within tasks, alternating large-star and small-star steps across."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .runtime import drop, table

#: So many edges at most (4 MB) are joined by one task; while there are more, steps over shuffles reduce them.
FEW = 1 << 18
_HELD = 1 << 21


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the graph (u, v) and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    p, q, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(p):
        # Roots hook on to smaller ones, so the smallest node stays the root; paths are halved until all are short.
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
        p, q = root[p], root[q]
        p, q = p[p != q], q[p != q]
    return nodes, nodes[root]


def _edges(u: list[np.ndarray], v: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    node, root = stars(np.concatenate(u), np.concatenate(v))
    return node[node != root], root[node != root]


def _join(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """The edges that a task reads, as stars: no node has more than one to a smaller node. ``whole``: every node and its root."""
    u, v, held = [], [], 0
    for batch in batches:
        u.append(batch.column(0).to_numpy(zero_copy_only=False)), v.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += len(batch)
        if held > _HELD:
            u, v = ([x] for x in _edges(u, v))
            held = 0
    if u:
        found = stars(np.concatenate(u), np.concatenate(v)) if whole else _edges(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "component"] if whole else ["u", "v"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _join(batches, True)


def components(spark: SparkSession, edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b), which are longs; a component is named by its smallest node.

    Every task first joins the edges that it reads itself. If more than ``few`` edges are left, each step makes every node
    point at smaller nodes until all edges are stars or few; minima are pre-aggregated before the shuffle, and the join
    that follows can be split where one node has very many neighbours.
    """
    kind = "u long, v long"
    now = table(spark, edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(_join, kind), "edges")
    state = _state(now)
    while state[0] > few:
        own = now.mapInArrow(_join, kind)
        both = own.select("u", "v").unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = table(spark, small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(spark, now)
        now, before = new, state
        state = _state(now)
        if state == before:
            break
    else:
        return now.coalesce(1).mapInArrow(_finish, "node long, component long")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
