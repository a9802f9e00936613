"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedlake.session import materialize


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two parents, or is parent and child: the edges are not yet stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return not per.where("child > 1 or (child = 1 and parent = 1)").isEmpty()


def connected_components(links: DataFrame, max_rounds: int = 50, known: DataFrame | None = None) -> DataFrame:
    """node, component (smallest node reachable) for every node that has a link.

    ``links``: columns a, b (long), either direction, repeats allowed; rows with a null end
    or equal ends are ignored. ``known``: an earlier result, whose links need not be given again.
    Each round is a written table, so a lost executor costs one round; nothing of it reaches
    the driver. Every step groups by node with a map-side minimum before the join, and the star
    of a hub is joined with one row. Raises if ``max_rounds`` rounds do not suffice (each
    at least halves the longest way to a smallest node, roughly)."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if known is not None:
        edges = edges.union(known.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")))
    edges = materialize(edges.distinct(), "cc-links")
    rounds = 0
    while _unfinished(edges):
        if rounds == max_rounds:
            raise RuntimeError(f"components are not complete after {max_rounds} rounds; raise max_rounds")
        rounds += 1
        # large-star: the larger neighbours of a node move to its smallest neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: the smaller neighbours of a node, and the node, move to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = materialize(small, "cc-round")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
