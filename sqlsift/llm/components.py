"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlsift.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of a node links to the least of its neighbourhood; small: the node and its smaller ones do."""
    both = links.union(links.select("v", "u")) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        return met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (u, v): every node that has one (node), with the least node it reaches (root)."""
    links = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == seen:
            break
        seen = mark
        links = stored(_star(_star(links, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
