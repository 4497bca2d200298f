"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v: every neighbour is tied to the smallest neighbour instead."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u")
    if large:
        return tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of links (a, b) with the smallest node reachable from it.

    Each round is written to the shared folder; the loop ends when a round changes nothing. Rounds grow with the
    logarithm of the links; should `most_rounds` not settle them, that is an error, never an unfinished result.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        edges = staged(star(star(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
