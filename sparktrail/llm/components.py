"""Connected components of large graphs, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) with the same components as edges a-b; at most one per node."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        label = new[label]
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them (and the node); large: only larger ones, else only smaller."""
    both = edges if not large else edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("m", "u"))
    linked = both.join(low, F.col("a") == F.col("u"))
    if large:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b) of longs; component: the smallest node. Nodes without an edge have no row.

    Each round is written to the shared folder, so lineage stays short. Neither step emits more edges than it reads, up
    to one per node; joins on a hub's key are split by adaptive execution.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.count_distinct("b"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(hash(a, b))")).first())
        if now == mark or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = now
        edges = materialize(_step(_step(edges, True), False), "edges")
