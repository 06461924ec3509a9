"""What an iteration writes, round by round, to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ferryline.session import new_folder, path_exists


class Rounds:
    """Rows written round by round below one folder, settled ones apart from those still open.

    Each side is a partition of its own: reading the settled rows of all rounds,
    or the open rows of the last one, touches no other file.
    """

    def __init__(self, spark, label: str, schema: T.StructType):
        self.spark, self.number = spark, -1
        self.names = schema.names
        self.layout = T.StructType([
            *schema.fields, T.StructField("round", T.IntegerType()), T.StructField("settled", T.BooleanType())])
        self.folder = new_folder(spark, label)

    def write(self, df: DataFrame, settled: Column) -> None:
        self.number += 1
        rows = df.select(*self.names, settled.alias("settled"))
        rows.write.partitionBy("settled").parquet(f"{self.folder}/round={self.number}")

    def _last(self) -> DataFrame:
        reader = self.spark.read.schema(self.layout).option("basePath", self.folder)
        return reader.parquet(f"{self.folder}/round={self.number}")

    def any_settled(self) -> bool:
        """Whether the last round settled a row: a partition is there only if it has rows."""
        return path_exists(self.spark, f"{self.folder}/round={self.number}/settled=true")

    def any_open(self) -> bool:
        return path_exists(self.spark, f"{self.folder}/round={self.number}/settled=false")

    def settled_now(self) -> DataFrame:
        return self._last().where("settled").select(*self.names)

    def open(self) -> DataFrame:
        return self._last().where("NOT settled").select(*self.names)

    def settled(self) -> DataFrame:
        """All rows settled so far, with the round it happened in."""
        return self.spark.read.schema(self.layout).parquet(self.folder).where("settled").select(*self.names, "round")
