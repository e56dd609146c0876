"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import counted


def star_forest(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of integer nodes -> (node, root), root the smallest node reachable, node != root.

    Alternates the large-star and small-star steps: each node's neighbours are hung below
    the smallest node it knows. Every step is a partial aggregate and equi-joins, so a hub
    is pre-aggregated and its join partition can be split; the rounds grow with the
    logarithm of the nodes. Each round is a table in the shared folder, and its write tells
    whether it changed anything.
    """
    def round_of(pairs: DataFrame) -> tuple[DataFrame, dict]:
        return counted(pairs, "links", checksum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))

    now, seen = round_of(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while seen != before and seen["rows"]:
        before = seen
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, seen = round_of(small.union(low.select("u", "m")).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
