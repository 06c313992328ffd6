"""Connected components of a link table, by alternating large and small stars.

Each round is joins and aggregations over the links, whose number never
grows; every round is written to the shared folder, which cuts the lineage.
Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.session import SORTED, release, stash


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b), a > b, moved to the smallest neighbour of their node; ``links`` is used up."""
    if large:  # each node tells its larger neighbours its smallest one (or itself)
        sides = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star-min")
        moved = (sides.where("b > a").join(least.hint(SORTED), "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    else:  # each node tells its smaller neighbours, and itself, its smallest one
        least = stash(links.groupBy("a").agg(F.min("b").alias("m")), "star-min")
        moved = links.join(least.hint(SORTED), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.select("a", F.col("m").alias("b"))).distinct()
    out = stash(moved, "links")
    release(links, least)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node reachable."""
    now = stash(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct(), "links")

    def shape(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = shape(now)
    while seen[0]:
        now = _star(_star(now, True), False)
        found = shape(now)
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
