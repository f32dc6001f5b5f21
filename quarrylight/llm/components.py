"""Connected components by alternating large-star and small-star steps.

Each step links the neighbours of a node to the smallest of them: first the larger neighbours, then the smaller ones.
After a number of rounds that grows with the logarithm of the longest path, every node is linked to the smallest node of
its component alone. A step is a map-side combined minimum and a join; each round is written to the shared folder, which
cuts the lineage. Links never reach the driver, only their count and checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs to (id, root), a row for every node that is not the smallest of its component."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen = None
    while True:
        links = written(_small_star(_large_star(links)), "stars")
        now = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**31)))).first()
        if now == seen:
            return links.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = now
