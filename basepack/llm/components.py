"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, root) of all nodes that have links, root being the smallest node reachable.

    ``links``: (a, b) of longs, any direction; loops and repeats are harmless.  Each round is two
    aggregations over as many rows as there are links, and the neighbours of a node are never
    collected: its smallest neighbour comes from an aggregation and joins back.
    """
    edges = ws.write(f"{name}_0", links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for i in itertools.count(1):
        # Large star: each neighbour above a node links to the smallest of node and neighbours.
        both = edges.union(edges.select("b", "a")).toDF("n", "m")
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("least"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        # Small star: each neighbour below a node, and the node, link to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = ws.write(f"{name}_{i}", small)
        same = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        if same:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
