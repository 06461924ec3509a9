"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.session import Scratch


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: long): root is the least node reachable.

    Each round hangs a node's greater neighbours below its least one, then its
    lesser neighbours as well; rounds grow with the logarithm of the longest
    chain.  Every round is written to the shared folder.  Rows with a null end
    and loops are left out.  No node gathers its neighbours in one row.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = scratch.put(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = scratch.put(small.union(lower.select("a", F.col("m").alias("b"))).distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
