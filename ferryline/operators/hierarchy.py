"""Order of the rows of a table that references itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.operators.merge import without
from ferryline.operators.rounds import Rounds

UNREACHED = 2147483647  # fixed value: depth of a row no root leads to


def roots(df: DataFrame, pk: str, fk: str) -> DataFrame:
    """Rows without a parent: foreign key null, or pointing outside `df`."""
    parents = df.select(F.col(pk).alias(fk))
    return without(df, parents, [fk])


def children_of(df: DataFrame, frontier: DataFrame, pk: str, fk: str) -> DataFrame:
    """Rows of `df` whose parent is in `frontier`: one step down the hierarchy."""
    parents = frontier.select(F.col(pk).alias(fk)).distinct()
    return df.join(parents, fk, "left_semi")


def chase(links: DataFrame) -> DataFrame:
    """(id, root, hops) for links(id, up, hops): the last id reached by going up, and the sum of hops on the way.

    A row whose `up` is null or no id of `links` is a root, at 0 hops.  Each round
    doubles the distance a row points over, so the rounds are the logarithm of
    the longest way.  A settled row is written once and never touched again;
    only rows still under way are rewritten.  When a round settles nothing, the
    rows left are on a cycle or below one: their root is null.
    """
    links = links.select("id", "up", "hops")
    below = links.join(links.select(F.col("id").alias("up")).distinct(), "up", "left_semi").select(
        "id", "up", F.lit(None).cast(links.schema["id"].dataType).alias("root"), "hops")
    none, zero = (F.lit(None).cast(links.schema["up"].dataType), F.lit(0).cast(links.schema["hops"].dataType))
    tops = roots(links, "id", "up").select("id", none.alias("up"), F.col("id").alias("root"), zero.alias("hops"))
    start = tops.union(below)
    rounds = Rounds(links.sparkSession, "hierarchy", start.schema)
    rounds.write(start, F.col("up").isNull())
    while rounds.any_settled() and rounds.any_open():
        under_way = rounds.open()
        known = rounds.settled().drop("round").union(under_way)
        ahead = known.select(F.col("id").alias("up"), F.col("up").alias("next"), "root", F.col("hops").alias("more"))
        step = under_way.drop("root").join(ahead, "up").select(
            "id", F.col("next").alias("up"), "root", (F.col("hops") + F.col("more")).alias("hops"))
        rounds.write(step, F.col("up").isNull())
    return rounds.settled().select("id", "root", "hops").unionByName(rounds.open().select("id", "root", "hops"))


def hierarchy_depth(df: DataFrame, pk: str, fk: str) -> DataFrame:
    """(pk, depth) for a table with a unique key and one parent per row."""
    found = chase(df.select(F.col(pk).alias("id"), F.col(fk).alias("up"), F.lit(1).alias("hops")))
    depth = F.when(F.col("root").isNull(), UNREACHED).otherwise(F.col("hops"))
    return found.select(F.col("id").alias(pk), depth.alias("depth"))


def hierarchy_order(df: DataFrame, pk: str, fk: str) -> DataFrame:
    """All rows and columns with their `depth`, parents before children, then by key."""
    return df.join(hierarchy_depth(df, pk, fk), pk).orderBy("depth", pk)


def unreached(df: DataFrame, pk: str, fk: str) -> DataFrame:
    """Rows on a cycle or below one (a row that is its own parent is one)."""
    depth = hierarchy_depth(df, pk, fk).where(F.col("depth") == UNREACHED)
    return df.join(depth, pk, "left_semi")
