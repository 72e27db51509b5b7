"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that edges a, b connect each with)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
        live = root[x] != root[y]
        x, y = x[live], y[live]
    return nodes, nodes[root]


def _forest(batches):
    got = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if got:
        nodes, roots = forest(*(np.concatenate(x) for x in zip(*got)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the least node that it is connected with.

    Each partition's edges shrink to a spanning forest, then star contraction runs until no edge moves.
    """
    edges = cut(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").mapInArrow(_forest, "a long, b long").distinct())
    loops = edges.filter("a = b").select("a")
    edges = edges.filter("a <> b")
    before = None
    while True:
        # large star: every larger neighbour of a node is tied to the node's least neighbour
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: the smaller neighbours and the node itself are tied to the least
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) as decimal(38, 0)))")).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).union(loops.select(F.col("a").alias("node"), F.col("a").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
