"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.session import durable


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b; any order, repeats allowed); root is the smallest.

    A large star hangs every larger neighbour of a node on the smallest node beside it, a small star
    does so for the smaller ones; both keep the components and together reach one star each in a number
    of rounds that grows with the logarithm of the longest path. Minima are combined before their shuffle and
    joined back. The neighbours of one node meet in one task of that join, as narrow rows in a sort-merge, unless the minima are small enough
    to be broadcast; SimHash links are forests per bucket, so a node has at most one link per other fingerprint near it. Each round is cut off by a
    reliable checkpoint; the driver sees a count and a checksum.
    """
    edges = durable(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    )
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(near.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
