"""Session settings and the shared folder that cut lineage is written to."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Settings the jobs are written for.  AQE splits skewed join partitions, merges
# small ones and turns a join into a broadcast once a side is measured small.
# A task that writes a versioned table holds rows of few buckets: with a few
# writers open at a time it needs no sort before the write.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str, master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Session with the recommended settings; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, or else the warehouse, which they share too."""
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch").rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder name of its own below the shared folder (not created yet)."""
    return f"{shared_folder(spark)}/ferryline/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and gives the planner
    the true size of the result, so that a later broadcast is a checked one.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """One table that is replaced over and over, such as the state of an iteration.

    The old rows are deleted once the new ones are written, so a long iteration
    holds two copies and not one per round.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.number = spark, new_folder(spark, label), 0

    def put(self, df: DataFrame, split_by: str | None = None) -> DataFrame:
        """Replace the rows; with `split_by` a later filter on that column reads only its files."""
        self.number += 1
        path = f"{self.folder}/{self.number}"
        writer = df.write.partitionBy(split_by) if split_by else df.write
        writer.parquet(path)
        if self.number > 1:
            self._delete(f"{self.folder}/{self.number - 1}")
        return self.spark.read.schema(df.schema).parquet(path)

    def holds(self, partition: str) -> bool:
        """Whether the present rows have a `column=value` partition; no job is run."""
        return path_exists(self.spark, f"{self.folder}/{self.number}/{partition}")

    def drop(self) -> None:
        """Delete the present rows; nothing that reads them may run any more."""
        self._delete(f"{self.folder}/{self.number}")

    def _delete(self, path: str) -> None:
        files, old = _file_system(self.spark, path)
        files.delete(old, True)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def sub_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; no job is run."""
    files, target = _file_system(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(target) if entry.isDirectory()]


def files_in(spark: SparkSession, path: str) -> dict[str, int]:
    """Sizes of the files in a folder, by name; no job is run."""
    files, target = _file_system(spark, path)
    return {entry.getPath().getName(): entry.getLen() for entry in files.listStatus(target) if entry.isFile()}


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all in it; whether it was there."""
    files, target = _file_system(spark, path)
    return files.delete(target, True)


def one_row(spark: SparkSession, **values: Column) -> DataFrame:
    """A single row of expressions, made inside the JVM."""
    return spark.range(0, 1, 1, 1).select(*[value.alias(name) for name, value in values.items()])
