"""A target in hash buckets of its key, merged into without moving its rows.

Every load is a bucketed table of its own in a new folder.  A line with its
number makes it the one that is read; nothing that may be read is overwritten.
As the buckets are known to the planner, an upsert shuffles the source only: each
task joins one bucket with the source rows that belong there and writes the bucket anew.
Buckets grow in number with the rows, so that a task's share stays the same.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.operators.merge import clean_keys, latest_per_key, no_null_key
from ferryline.session import path_exists

POINTERS = T.StructType([T.StructField("version", T.LongType()), T.StructField("run_id", T.StringType()), T.StructField("buckets", T.IntegerType())])
BUCKET_ROWS = 500_000  # rows a bucket is meant for at most
FILLED = "a key of a bucketed table must not be NULL"


class BucketedTable:
    """A table below `folder`, bucketed and sorted by `keys`; keys are unique and never NULL.

    A task handles a bucket, so a version has `buckets` of them, doubled until `BUCKET_ROWS`
    rows fit each; an upsert that finds too few deals the target anew once.  An upsert
    rewrites the table, so give it batches that are a good part of it; `VersionedTable`
    rewrites only the buckets a small batch meets.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], buckets: int):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.keys, self.buckets = clean_keys(keys), buckets

    def _name(self, version: int) -> str:
        """Name of a version in the session's catalog."""
        label = re.sub(r"\W", "_", self.folder.rsplit("/", 1)[-1])
        return f"bucketed_{label}_{hashlib.md5(self.folder.encode()).hexdigest()[:12]}_v{version}"

    def version(self) -> int:
        """Number of the published version; 0 before the first load."""
        return self._published()[0]

    def _published(self) -> tuple[int, int]:
        """The published version and its number of buckets."""
        if not path_exists(self.spark, f"{self.folder}/published"):
            return 0, self.buckets
        pointers = self.spark.read.schema(POINTERS).json(f"{self.folder}/published")
        version, buckets = pointers.agg(F.max("version"), F.max_by("buckets", "version")).first()
        return version or 0, buckets or self.buckets

    def _wanted_buckets(self, source: DataFrame) -> int:
        """Buckets of the next version, by the rows of the target and of the source; counted, not fetched."""
        rows, buckets = max(source.count(), self.read().count()), self._published()[1]
        while rows > buckets * BUCKET_ROWS:
            buckets *= 2
        return buckets

    def read(self) -> DataFrame:
        """The published rows, as a scan of the buckets; a session that did not write them declares them first."""
        version, buckets = self._published()
        if not version:
            return self.spark.createDataFrame([], self.schema)
        name = self._name(version)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            keys = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                           f"INTO {buckets} BUCKETS LOCATION '{self.folder}/version={version}'")
        return self.spark.table(name)

    def merged(self, source: DataFrame, order_by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
        """The published rows after upserting `source`: matched ones replaced, others inserted.

        Of equal keys the row of greatest `order_by` counts.  The source is counted, then read once and its
        keys cut down to one row each before they move; the target is read once and does not move
        unless the rows come in more buckets than it has.
        """
        buckets = buckets or self._wanted_buckets(source)
        checked = source.select(*self.schema.names).withColumn(
            self.keys[0], F.when(no_null_key(self.keys), F.col(self.keys[0])).otherwise(F.raise_error(F.lit(FILLED))))
        newest = latest_per_key(checked, self.keys, order_by).repartition(buckets, *self.keys)
        version, stored = self._published()
        if not version:
            return newest
        incoming = newest.select(*self.keys, F.struct(*[F.col(c) for c in self.schema.names]).alias("_new"))
        target = self.read() if stored == buckets else self.read().repartition(buckets, *self.keys)
        both = target.join(incoming, self.keys, "full_outer")
        return both.select(*[F.col(c) if c in self.keys else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(
            F.col(c)).alias(c) for c in self.schema.names])

    def upsert(self, source: DataFrame, run_id: str, order_by: list[str] | None = None) -> int:
        """Write the merged rows as the next version and publish it; its number."""
        version, buckets = self.version() + 1, self._wanted_buckets(source)
        rows = self.merged(source, order_by, buckets)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(version)}")  # a try that was never published
        writer = rows.write.format("parquet").mode("overwrite").option("path", f"{self.folder}/version={version}")
        writer.bucketBy(buckets, *self.keys).sortBy(*self.keys).saveAsTable(self._name(version))
        self.spark.createDataFrame([(version, run_id, buckets)], POINTERS).coalesce(1).write.mode("append").json(f"{self.folder}/published")
        return version
