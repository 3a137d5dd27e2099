"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two grouped minima and joins over links that only get fewer or
point to smaller nodes; a round's links are kept in a reliable checkpoint, and its
shuffle files go with it.  The number of rounds grows with the logarithm of the longest chain.  Nothing but two
numbers a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, freed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (the larger ones, or it and the smaller ones) to its least neighbour."""
    if large:
        both = links.union(links.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """For every node of links (a long, b long) that is not its component's least node: node, root (the least)."""
    links = cut(links.where("a != b").distinct())
    seen = None
    while True:
        with freed(links.sparkSession):
            state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        links = cut(_star(_star(links, True), False))
