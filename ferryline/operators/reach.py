"""What lies below some nodes of a large graph, hop by hop, with the nodes seen so far kept as bitmaps.

Nodes are numbered once, by a sort.  Edges lie in files by the part of the
numbers their parent falls in, bitmaps by the part of their own.  A hop reads
the edges of the parts its frontier is in, then the bitmaps of the parts
it comes to, and nothing else; the other ids seen are never read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.session import materialize, new_folder, sub_folders

PART_BITS = 21  # numbers of a part: 2^21, of which a full bitmap takes a quarter of a MB
FILES = 8  # of each part of the edges


def _part(number: str) -> Column:
    return F.shiftright(number, PART_BITS)


def _in_bitmap(bitmap: str, number: str) -> Column:
    """Whether the bit of a number is set in the bitmap of its bucket."""
    position = F.bitmap_bit_position(number).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, position % 8) == 1


class _Parts:
    """Rows below one folder in sub-folders part=...; several writes add up."""

    def __init__(self, spark, label: str):
        self.spark, self.folder, self.schema, self.rounds = spark, new_folder(spark, label), None, 0

    def add(self, df: DataFrame) -> list[int]:
        """Write rows that have a `part`; the parts written."""
        self.schema, path = df.schema, f"{self.folder}/round={self.rounds}"
        df.write.partitionBy("part").parquet(path)
        self.rounds += 1
        return [int(name.removeprefix("part=")) for name in sub_folders(self.spark, path) if name.startswith("part=")]

    def read(self, parts: list[int] | None = None, last: bool = False) -> DataFrame:
        """Rows of the given parts, of all writes or the last one."""
        layout = T.StructType([*self.schema.fields, T.StructField("round", T.IntegerType())])
        path = f"{self.folder}/round={self.rounds - 1}" if last else self.folder
        rows = self.spark.read.schema(layout).option("basePath", self.folder).parquet(path)
        return rows if parts is None else rows.where(F.col("part").isin(parts))


def hops_by_bitmaps(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, hops): the distinct `seeds` (id) and all below them over `edges` (parent, child), by least number of edges."""
    spark = edges.sparkSession
    ends = edges.select(F.col("parent").alias("id")).union(edges.select("child")).union(seeds.select("id"))
    numbered = ends.where("id IS NOT NULL").distinct().orderBy("id").select(
        "id", (F.monotonically_increasing_id() + 1).alias("number"))
    numbered = materialize(numbered, "numbered")
    above, below = (numbered.select(F.col("id").alias(end), F.col("number").alias(f"{end}_number")) for end in ("parent", "child"))
    links = _Parts(spark, "links")
    links.add(edges.join(above, "parent").join(below, "child").select(
        "parent_number", F.col("child_number").alias("number"), _part("parent_number").alias("part")).repartition(
        "part", F.pmod(F.hash("number"), F.lit(FILES))))
    frontier, seen = _Parts(spark, "frontier"), _Parts(spark, "bitmaps")
    parts = frontier.add(seeds.join(numbered, "id").select("number", _part("number").alias("part")))
    bucket = F.bitmap_bucket_number("number")
    while parts:
        new = frontier.read(last=True)
        bits = new.groupBy("part", bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
        seen.add(bits)
        at = new.select(F.col("number").alias("parent_number"))
        reached = _Parts(spark, "reached")
        came = reached.add(links.read(parts).join(at, "parent_number").select("number").distinct().select(
            "number", _part("number").alias("part")))
        if not came:
            break
        known = seen.read(came).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        ahead = reached.read().withColumn("bucket", bucket).join(known, "bucket", "left")
        parts = frontier.add(ahead.where(F.col("bits").isNull() | ~_in_bitmap("bits", "number")).select("number", "part"))
    return frontier.read().select("number", F.col("round").alias("hops")).join(numbered, "number").select("id", "hops")
