"""Connected components of an edge table, on Spark throughout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricecast.llm.common import checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is its smallest node.

    Alternating large-star and small-star rounds: every node with all its neighbours is hooked to
    the smallest of them, until the edge set is a forest of stars. The number of rounds is
    logarithmic in a component's length. Minima are pre-aggregated before the shuffle, and the
    joins that follow are plain equi-joins that adaptive execution may split on a hub. Each
    round is written to the shared checkpoint folder; nothing but a count and a checksum
    reaches the driver. Loops and repeated edges are ignored; no edges give no rows.
    """
    cur = checkpoint(edges.where(F.col("a") != F.col("b"))
                     .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct())
        large = checkpoint(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where(F.col("b") != F.col("m"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        cur = checkpoint(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    stars = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (node, smallest member) of the graph of edges a-b."""
    nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ids[:len(a)], ids[len(a):]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[x], lab[y])
        new = lab.copy()
        np.minimum.at(new, lab[x], low)
        np.minimum.at(new, lab[y], low)
        new = new[new]
        new = np.minimum(lab, new[lab])
        if (new == lab).all():
            break
        lab = new
    off = lab != np.arange(len(nodes))
    return nodes[off], nodes[lab[off]]
