"""Connected components over an edge table that is never collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import gathered, materialize, release

#: Edges that a task joins in memory at a time before the first round.
EDGES_AT_ONCE = 1 << 20


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as ``a`` and ``b`` do, each from a node to its component's smallest; a node without another gets a self loop."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    keep = (root != np.arange(len(nodes))) | (np.bincount(root, minlength=len(nodes))[root] == 1)
    return nodes[keep], nodes[root[keep]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams edges (a, b); passes on those that are left of every EDGES_AT_ONCE or so."""
    held, size = [], 0

    def left() -> pa.RecordBatch:
        u, v = contract(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")])
        size += batch.num_rows
        if size >= EDGES_AT_ONCE:
            yield left()
            held, size = [], 0
    if size:
        yield left()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Every task first joins what its own edges join. Then the large-star and
    small-star steps alternate: each is a partially aggregated minimum per node
    and an equi-join back, so a hub's edges are split by AQE rather than
    gathered. A round begins with each node's least neighbour, and where all
    nodes have no smaller neighbour or a single one and no larger, those are the
    roots. Rounds are written to the shared folder, so the plan stays short and
    lost executors cost one round; few edges are written by few tasks.
    Self loops give single-node components. An empty table gives an empty one.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = materialize(pairs.mapInArrow(_contracted, "u bigint, v bigint"), "edges")
    for _ in range(most_rounds):
        n = 2 * e.count()
        both = e.union(e.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("v"), F.max(F.when(F.col("v") != F.col("u"), F.col("v"))).alias("top"))
        near = materialize(gathered(near.select("u", F.least("u", "v").alias("m"), "top"), n), "nearest")
        if near.where("m < u AND top != m").isEmpty():
            release(e)
            return near.select(F.col("u").alias("node"), F.col("m").alias("root"))
        large = both.where("v > u").join(near.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.union(down.select("u", F.col("m").alias("v"))).union(e.where("u = v"))
        after = materialize(gathered(after.distinct(), n), "edges")
        release(e, near)
        e = after
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
