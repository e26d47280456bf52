"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """The smallest node that each node of links (a, b) can reach: rows (node, label).

    Nodes may be of any type with an order. Links from a node to itself, or with a null
    end, do not count. A round replaces each node's larger neighbours, then its smaller
    ones, by links to the smallest node seen there; the links become stars in a number
    of rounds that grows as the logarithm of the longest path. Each round is
    checkpointed, and only its link count and hash sum reach the driver.
    """
    links = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct().checkpoint()
    last = None
    for _ in range(max_rounds):
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(links.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        links_next = large.join(down, "hi").select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo < hi").distinct().checkpoint()
        state = links_next.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")).alias("h")).first()
        links = links_next
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("label"))).distinct()
