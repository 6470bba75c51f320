"""Connected components of a graph given by its links, without gathering them on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node with a link to another node, the smallest node it reaches.

    Alternates the large-star and small-star steps until the links no longer change. Each step takes the least
    neighbour of a node by an aggregate (combined before the shuffle) and an equality join, which adaptive
    execution splits where a hub holds many links. Links are checkpointed once a round. Loops, repeated links
    and links with null ends are ignored; with no links the result is empty.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges, before = checkpoint(edges), None
    while True:
        n, mark = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if (n, mark) == before or not n:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = n, mark
        # large star: every larger neighbour of a node goes to the node's least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: every smaller neighbour, and the node itself, goes to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = checkpoint(small)
