"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.sources.tables import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least node of its component) for every node that has a link to another.

    Large-star and small-star steps alternate until nothing moves: each node hands its neighbours to the
    least of them. Minima are combined before the shuffle, and no node's neighbours are gathered. Each
    round is written, so a lost executor costs one round at most.
    """

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    edges = materialize(links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        # Large star: neighbours above u go to the least neighbour of u.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        # Small star: u and its neighbours below go to the least of them.
        small = large.join(least(large), "u")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small.select("u", F.col("m").alias("v")).filter("u <> v"))
        old, edges = edges, materialize(moved.distinct(), "small-star")
        discard(old, large)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
