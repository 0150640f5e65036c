"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Edges stay distributed; each round is written to the shared folder and cuts the
lineage. A node's smallest neighbour comes from a partial minimum before the
exchange, and the join back carries the edges, whose hot nodes the engine splits.

Edge cases: edges with a null end and from a node to itself link nothing; repeated edges
count once; nodes are numbers; no edges give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for every node of these edges but the least ones."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def contract(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Each task replaces its edges, up to ``most`` at a time, by a spanning star: the same components, fewer edges."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def stars() -> pa.RecordBatch:
            a, b = spanning_edges(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                n += batch.num_rows
            if n >= most:
                yield stars()
                held, n = [], 0
        if held:
            yield stars()

    return edges.mapInArrow(kernel, "u long, v long")


def connected_components(edges: DataFrame, u: str, v: str, contracted: bool = False, max_rounds: int = 50) -> DataFrame:
    """(node, component), the component being its least node, for every node that isn't its component's least.

    ``contracted``: the edges come as spanning stars already, so tasks needn't make some."""
    edges = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    now = cut((edges if contracted else contract(edges).where("u <> v")).distinct())
    state = digest(now)
    for _ in range(max_rounds):
        now = cut(small_star(large_star(now)))
        before, state = state, digest(now)
        if state == before:
            break
    else:
        raise RuntimeError("components haven't settled; raise max_rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def digest(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def own_key(node: str) -> Column:
    """The node as a key that doesn't show where its rows already are: both sides of the join are
    then exchanged, which is what lets the engine split the partition of a hot node."""
    return F.col(node).bitwiseXOR(F.lit(0))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour, or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(own_key("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and itself, is linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.select(own_key("u").alias("w"), "m"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
