"""Connected components of an edge table: forests within partitions, then alternating large-star and small-star steps.

Edges never leave the executors. Each partition first cuts its edges to a forest, so a dense group shrinks to one edge per node. While more than
AT_ONCE edges remain, star rounds run, each written to the shared folder; a remainder of at most AT_ONCE edges (16 bytes each) is
finished in one task. Both ways give the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stash

AT_ONCE = 2_000_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges in ascending order, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def _edges(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(h[0] for h in held)]), np.concatenate([none, *(h[1] for h in held)])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the partition's edges, cut again whenever AT_ONCE of them are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def cut() -> tuple[np.ndarray, np.ndarray]:
        nodes, root = roots(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        on = nodes != root
        return nodes[on], root[on]

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size >= AT_ONCE:
            u, v = cut()
            held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
    if held:
        u, v = cut()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes, root = roots(*_edges(batches))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    return joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, stash: Stash, at_once: int = AT_ONCE) -> DataFrame:
    """node, component (smallest node reachable) for every node with an edge to another, of edges u, v (longs; loops and repeats allowed)."""
    now = stash.put(edges.select("u", "v").filter("u != v").mapInArrow(_forest, "u long, v long"))
    n, seen = now.count(), None
    while n > at_once:
        after = stash.put(_small_star(_large_star(now)).filter("u != v").distinct())
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        stash.drop(now)
        now, n = after, state.n
        if seen == (state.n, state.s):  # every edge leads to its component's smallest node
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = (state.n, state.s)
    return stash.put(now.coalesce(1).mapInArrow(_label, "node long, component long"))
