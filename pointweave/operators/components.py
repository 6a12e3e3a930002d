"""Connected components over an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pointweave.session import cut

CHUNK = 1_000_000  # edges contracted at a time inside a task; bounds its memory
NEAR_BITS = 18  # ids that agree but for so many bits are contracted together where edges mostly join near ids


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star forest (node, smallest member) with the same connectivity as the edges."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a):]
    parent = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
        np.minimum.at(parent, high, low)
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
        open_ = parent[u] != parent[v]
        u, v = u[open_], v[open_]
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _contract_batches(batches):
    held, size = [], 0

    def flush():
        table = pa.Table.from_batches(held)
        node, root = contract(table["a"].to_numpy(), table["b"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _local_forest(edges: DataFrame) -> DataFrame:
    """Shrink every task's share of the edges to a forest, in bounded chunks."""
    return edges.mapInArrow(_contract_batches, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step: link neighbours to the smallest one.

    Minima are folded before the shuffle; the join against them is one row per
    node, so a node with very many neighbours is split by AQE like any skewed key.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = both.join(smallest, "a")
    if large:
        moved = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            smallest.select("a", F.col("m").alias("b"))
        )
    return moved.where(F.col("a") != F.col("b")).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    several = edges.groupBy("a").count().where(F.col("count") > 1)
    if not several.isEmpty():
        return False
    return edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def component_roots(edges: DataFrame, a: str = "a", b: str = "b", near: bool = False) -> DataFrame:
    """(node, root) for every node that is not itself the smallest of its component.

    Alternates large-star and small-star steps until all edges form stars. Each
    round first contracts the edges inside the tasks, so few rounds remain. With
    ``near`` edges of near ids are brought into one task before the first contraction,
    which then leaves little where ids follow the surface, as those of faces do.
    """
    pairs = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
    if near:
        pairs = pairs.repartition(F.shiftright("a", NEAR_BITS))
    current = cut(_local_forest(pairs.where(F.col("a") != F.col("b"))))
    while not _is_forest_of_stars(current):
        current = cut(_local_forest(_star(current, large=True)))
        if _is_forest_of_stars(current):
            break
        current = cut(_star(current, large=False))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", near: bool = False) -> DataFrame:
    """(node, root) for every node; root is the smallest id of its component."""
    roots = component_roots(edges, near=near)
    return nodes.select(F.col(node).alias("node")).join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
