"""Connected components of a link table, by alternating large and small stars.

Each round is two aggregations and joins over the links; the rounds needed grow with the logarithm of the
longest chain. Links never pass through the driver, only the count of those that changed does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stage

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b (any order, repeats and loops allowed). Returns node, component (the smallest node),
    for every node but those that are their own component's smallest."""
    edges = stage(_ordered(links.select("a", "b")), "links")
    for _ in range(MAX_ROUNDS):
        large = stage(_star(edges, all_neighbours=True), "large")
        small = stage(_star(large, all_neighbours=False), "small")
        # done when every node hangs on exactly one root that is no node itself
        loose = small.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a").limit(1).count()
        if not loose:
            chained = small.join(small.select(F.col("b").alias("root")).distinct(), F.col("a") == F.col("root"), "left_semi").limit(1).count()
            if not chained:
                return small.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = small
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger node a to the smaller b."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, all_neighbours: bool) -> DataFrame:
    """edges have a > b. Large star: every node's larger neighbours move to its smallest one (itself counts).
    Small star: every node's smaller neighbours, and itself, move to the smallest."""
    if all_neighbours:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return _ordered(moved)
