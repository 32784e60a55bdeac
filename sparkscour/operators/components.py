"""Connected components of a graph that is given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscour.session import durable, join_hot

# Edges that a task holds at once while it contracts them.
CHUNK_EDGES = 1_000_000
# Contracted edges that one task may finish alone, instead of rounds over all tasks.
LAST_EDGES = 1_000_000
# Rows that this task gives back at once.
ROWS_AT_ONCE = 1 << 16


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and, for each, the smallest node it reaches by them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(ends[0]):
        # Every root takes the smallest root that an edge joins it to, then paths are cut short.
        np.minimum.at(root, ends[0], ends[1])
        np.minimum.at(root, ends[1], ends[0])
        while (root[root] != root).any():
            root = root[root]
        ends = root[ends]
        ends = ends[:, ends[0] != ends[1]]
    return nodes, nodes[root]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges ``u > v`` with the same components, at most one per node and chunk of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            node, root = smallest_reached(table["u"].to_numpy(), table["v"].to_numpy())
            moved = node != root
            return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(root[moved])], ["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= CHUNK_EDGES:
                yield emit()
                held.clear()
        if held:
            yield emit()

    return edges.mapInArrow(run, "u long, v long")


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of one task's edges with the smallest node that each reaches."""
    held = [batch for batch in batches if batch.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        node, root = smallest_reached(table["u"].to_numpy(), table["v"].to_numpy())
        for low in range(0, len(node), ROWS_AT_ONCE):
            part = slice(low, low + ROWS_AT_ONCE)
            yield pa.RecordBatch.from_arrays([pa.array(node[part]), pa.array(root[part])], ["node", "component"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (the smallest node it reaches) of every node with an edge.

    Tasks contract what they hold. If at most ``LAST_EDGES`` are left, one task finishes them when the
    result is read; else stars: each node hands its larger neighbours to its smallest one, and its smaller ones too, until
    nothing changes. Paths shrink by a power in each round, so there are few. Edges of a node to itself,
    or without a node, join nothing.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    held = durable(contracted(pairs.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")))
    left = held.count()
    if left > LAST_EDGES:
        held = durable(held.distinct())
        seen = _mark(held)
        left = seen[0]
    if left <= LAST_EDGES:
        return held.repartition(1).mapInArrow(_finished, "node long, component long")
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = join_hot(both.filter("v > u"), least, "u", spread_by=F.col("v"))
        large = up.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = join_hot(large, least, "u", spread_by=F.col("v"))
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        held = durable(small.distinct())
        now = _mark(held)
        if now == seen:
            break
        seen = now
    roots = held.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return row[0], row[1]
