"""Table scans and the parquet target of loads: a folder for each load, a row that publishes it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.operators.merge import clean_keys, merge_newest, merge_upsert, no_null_key, rows_to_write
from ferryline.session import delete_path, one_row, path_exists, sub_folders
from ferryline.sources.logs import roll_log

BUCKET = "load_bucket"
VERSION = "load_version"
BUCKET_ROWS = 4_000_000  # rows a bucket is meant for
MOST_BUCKETS = 4096      # a larger table has larger buckets, of more files each; no task handles a bucket as a whole

# A load with `base` equal to its version wrote the whole table anew; any other one added rows, or
# wrote the buckets in `replaced` anew.
LOG_SCHEMA = """
    version bigint, run_id string, entry string, cursor string, selected bigint, buckets int, n_rows bigint,
    base bigint, replaced array<int>
"""


def scan(spark: SparkSession, name: str, folder: str | None = None, schema: str | None = None) -> DataFrame:
    """A whole table: parquet below `folder`, else a catalog table, its schema prefix dropped when blank."""
    if folder:
        return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return spark.table(f"{schema}.{name}" if schema and schema.strip() else name)


@dataclass(frozen=True)
class View:
    """What a reader sees: loads `base` to `version`, and of a bucket in `since` only those from that load on."""

    version: int = 0
    base: int = 1
    buckets: int | None = None
    n_rows: int = 0
    since: dict[int, int] = field(default_factory=dict)

    def covers(self) -> Column:
        """The same as a filter on the partition columns alone, so that other folders are not opened."""
        seen = F.col(VERSION).between(self.base, self.version)
        if not self.since:
            return seen
        first = F.create_map(*[F.lit(value) for pair in sorted(self.since.items()) for value in pair])
        return seen & (F.col(VERSION) >= F.coalesce(F.try_element_at(first, F.col(BUCKET)), F.lit(self.base)))


@dataclass(frozen=True)
class Staged:
    """Rows written for the next version of a table but not visible yet."""

    view: View
    replaced: list[int]
    rows_before: int

    @property
    def rows_after(self) -> int:
        return self.view.n_rows


def _commit_row(staged: Staged, run_id: str, cursor: str | None, entry: str | None, selected: int | None) -> dict:
    view = staged.view
    return {"version": view.version, "run_id": run_id, "entry": entry, "cursor": cursor, "selected": selected,
            "buckets": view.buckets, "n_rows": view.n_rows, "base": view.base, "replaced": staged.replaced}


class VersionedTable:
    """A parquet table that a load changes as a whole or not at all.

    A load writes a folder of its own, `data/load_version=v/`, partitioned by
    `load_bucket`; one row in `commits` then makes it part of the table.  Nothing
    that may be read is overwritten, and what is in force is a filter on the two
    partition columns.  A full load writes the table anew, an append adds rows, and
    a small upsert writes only the buckets that its keys fall in anew.

    The bucket of a key is `pmod(hash(key), buckets)` over the table's own key
    types.  Without a given count a table has a bucket for each `BUCKET_ROWS`, a
    power of two; an upsert that finds it twice as large as that writes it anew.

    One writer at a time per table.
    """

    enforces_constraints = False

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType,
                 keys: list[str] | None = None, buckets: int | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys = [k for k in keys or []]
        if buckets is not None and buckets > 1 and not self.keys:
            raise ValueError("a table without keys has one bucket")
        self.fixed_buckets = buckets

    # -- reading --------------------------------------------------------------

    def _log(self) -> DataFrame | None:
        """The rows that published loads; None before the first."""
        try:
            return self.spark.read.schema(LOG_SCHEMA).json(f"{self.path}/commits")
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def commit_of(self, run_id: str, entry: str | None = None) -> dict | None:
        """The newest commit of a run, or of one entry of its contract, for a run that is started again."""
        log = self._log()
        own = F.lit(True) if entry is None else F.col("entry") == entry
        found = log.where((F.col("run_id") == run_id) & own).orderBy(F.desc("version")).limit(1).collect() if log else []
        return found[0].asDict() if found else None

    def view(self, version: int | None = None) -> View:
        """What is in force at a version, the newest by default; at most a number for each bucket is fetched."""
        log = self._log()
        if log is None:
            return View()
        if version is not None:
            log = log.where(F.col("version") <= version)
        last = log.orderBy(F.desc("version")).first()
        if last is None:
            return View()
        since = {}
        if last["base"] < last["version"]:
            later = log.where(F.col("version") > last["base"]).select("version", F.explode("replaced").alias("bucket"))
            since = {r["bucket"]: r["since"] for r in later.groupBy("bucket").agg(F.max("version").alias("since")).collect()}
        return View(last["version"], last["base"], last["buckets"], last["n_rows"], since)

    def read(self) -> DataFrame:
        """The rows of the newest published version."""
        return self._rows(self.view())

    def read_near(self, rows: DataFrame) -> DataFrame:
        """The stored rows that may share a key with `rows`: of the buckets these fall in, between their least and greatest first key.

        Other buckets are not opened, and of these files the row groups out of range are skipped.
        """
        view = self.view()
        if not view.version or not self.keys:
            return self._rows(view)
        keyed, first = self._shaped(rows.select(*self.keys), self.keys), F.col(self.keys[0])
        buckets = F.collect_set(self._bucket(view.buckets, self.keys))  # at most as many values as buckets
        hit, least, greatest = keyed.where(no_null_key(self.keys)).agg(buckets, F.min(first), F.max(first)).first()
        stored = self._rows(view, hit)
        plain = isinstance(self.schema[self.keys[0]].dataType, (T.IntegralType, T.StringType, T.DateType))
        return stored.where(first.between(F.lit(least), F.lit(greatest))) if plain else stored

    def count(self) -> int:
        """Rows in the newest version; known from the commit, nothing is scanned."""
        return self.view().n_rows

    def _rows(self, view: View, only: list[int] | None = None) -> DataFrame:
        """The rows of a view, of all buckets or of some."""
        if not view.version:
            return self.spark.createDataFrame([], self.schema)
        stored = self._stored().where(view.covers())
        return (stored if only is None else stored.where(F.col(BUCKET).isin(only))).select(*self.schema.names)

    def _stored(self) -> DataFrame:
        """The rows of all loads, published or not."""
        layout = T.StructType([*self.schema.fields, T.StructField(VERSION, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(layout).parquet(f"{self.path}/data")

    # -- writing --------------------------------------------------------------

    def _wanted_buckets(self, n_rows: int) -> int:
        """A bucket for each `BUCKET_ROWS`, as a power of two."""
        if self.fixed_buckets or not self.keys:
            return self.fixed_buckets or 1
        return min(MOST_BUCKETS, 1 << (n_rows // BUCKET_ROWS).bit_length())

    def _bucket(self, buckets: int, names: list[str] | None = None) -> Column:
        """The bucket of a row; `names` are the columns at hand where they are not all."""
        if buckets == 1:
            return F.lit(0)
        hashable = [f.name for f in self.schema if f.name in (names or self.schema.names) and not isinstance(f.dataType, (T.MapType, T.VariantType))]
        keyless = F.pmod(F.hash(*[F.col(c) for c in hashable]), F.lit(buckets))
        keyed = F.pmod(F.hash(*[F.col(k) for k in self.keys]), F.lit(buckets))
        return F.when(no_null_key(self.keys), keyed).otherwise(keyless)

    def _shaped(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """The table's columns in its own types: an int and a bigint key would hash to different buckets."""
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema if f.name in (names or self.schema.names)])

    def _write(self, rows: DataFrame, version: int, buckets: int, together: bool = False) -> int:
        """Write the folder of a load; its number of rows, counted from the files (footers only), exact even if tasks were repeated."""
        folder = f"{self.path}/data/{VERSION}={version}"
        placed = rows.withColumn(BUCKET, self._bucket(buckets))
        if together and buckets > 1:
            placed = placed.hint("rebalance", BUCKET)  # few files a bucket, and a large bucket in several tasks
        placed.write.mode("overwrite").partitionBy(BUCKET).parquet(folder)  # a try that died may have left files there
        return self.spark.read.schema(self.schema).parquet(folder).count()

    def stage_append(self, df: DataFrame, n_rows: int | None = None) -> Staged:
        """INSERT: every row as it is; `n_rows` is their number where it is known."""
        rows, now = self._shaped(df), self.view()
        buckets = now.buckets or self._wanted_buckets(self._counted(rows, n_rows))
        added = self._write(rows, now.version + 1, buckets, together=True)
        return Staged(replace(now, version=now.version + 1, buckets=buckets, n_rows=now.n_rows + added), [], now.n_rows)

    def stage_appends(self, df: DataFrame, batch: str, sizes: list[int]) -> list[Staged]:
        """INSERT of several batches in one pass: rows with 0 in the column `batch` make the next version, those with 1 the one after it.

        `sizes` are the rows of each batch, counted beforehand.
        """
        now, folder = self.view(), f"{self.path}/data"
        buckets, first = now.buckets or self._wanted_buckets(sum(sizes)), now.version + 1
        for name in sub_folders(self.spark, folder) if path_exists(self.spark, folder) else []:
            if name.startswith(f"{VERSION}=") and int(name.rpartition("=")[2]) >= first:
                delete_path(self.spark, f"{folder}/{name}")  # a try that died may have left files there
        shaped = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        placed = df.select(*shaped, (F.col(batch) + F.lit(first)).cast("long").alias(VERSION)).withColumn(BUCKET, self._bucket(buckets))
        placed.hint("rebalance", VERSION, BUCKET).write.mode("append").partitionBy(VERSION, BUCKET).parquet(folder)
        written = self._stored().where(F.col(VERSION) >= first).groupBy(VERSION).count().collect()  # from the files, as for one load
        added, staged = {r[0]: r[1] for r in written}, []
        for version in range(first, first + len(sizes)):
            view = replace(now, version=version, buckets=buckets, n_rows=now.n_rows + added.get(version, 0))
            staged, now = [*staged, Staged(view, [], now.n_rows)], view
        return staged

    def stage_upsert(self, df: DataFrame, keys: list[str] | None = None, order_by: list[str] | None = None,
                     small_batch: bool = False, keep_newer: bool = False, keys_set: bool = False,
                     n_rows: int | None = None) -> Staged:
        """UPSERT on `keys` (the table's own when none are given).

        With `small_batch` the buckets the batch falls in are looked up first
        and the others stay as they are; a full load skips that pass.
        With `keep_newer` a stored row stays where the batch's is older by `order_by`.
        `keys_set` says that the rows were checked to have no NULL in their keys,
        `n_rows` is their number where it is known.
        """
        keys = clean_keys(keys or self.keys)
        rows, now = self._shaped(df), self.view()
        wanted = self._wanted_buckets(max(now.n_rows, self._counted(rows, n_rows)))
        version, hit = now.version + 1, None
        if small_batch and now.version and keys == self.keys and 1 < now.buckets > wanted // 2:
            hit = sorted(r[0] for r in rows.select(self._bucket(now.buckets)).distinct().collect())  # at most `buckets` values
        stored, buckets = self._rows(now, hit), wanted if hit is None else now.buckets
        if not now.version:
            merged = rows_to_write(rows, keys, order_by, keys_set)
        elif keep_newer and order_by:
            merged = merge_newest(stored, rows, keys, order_by)
        else:
            merged = merge_upsert(stored, rows, keys, order_by, keys_set)
        written = self._write(merged, version, buckets)
        if hit is None:
            return Staged(View(version, version, buckets, written), [], now.n_rows)
        view = replace(now, version=version, n_rows=now.n_rows - stored.count() + written, since=now.since | dict.fromkeys(hit, version))
        return Staged(view, hit, now.n_rows)

    def _counted(self, rows: DataFrame, n_rows: int | None) -> int:
        """The number of rows, counted only where it sets the number of buckets and isn't known."""
        if self.fixed_buckets or not self.keys:
            return 0
        return rows.count() if n_rows is None else n_rows

    def staged_rows(self, staged: Staged) -> DataFrame:
        return self._rows(staged.view)

    def publish(self, staged: Staged, run_id: str, cursor: str | None = None, entry: str | None = None,
                selected: int | None = None) -> None:
        """Make a staged version the one in force: one row, one file, one rename."""
        self._commit([_commit_row(staged, run_id, cursor, entry, selected)])

    def publish_all(self, staged: list[Staged], run_ids: list[str], cursors: list[str | None], entry: str | None,
                    selected: list[int]) -> None:
        """Make staged versions that follow each other the ones in force, all or none: a row each, one file."""
        self._commit([_commit_row(*one, entry, n) for *one, n in zip(staged, run_ids, cursors, selected, strict=True)])

    def _commit(self, rows: list[dict]) -> None:
        lines = F.explode(F.array(*[F.lit(json.dumps(row)) for row in rows]))
        one_row(self.spark, value=lines).write.mode("append").text(f"{self.path}/commits")

    def vacuum(self, keep_versions: int = 2) -> int:
        """Delete the folders that none of the newest versions needs, a bucket of a load each, and roll the commits; returns how many.

        Not while a reader may still be on an older version, and not beside a writer.
        """
        log = self._log()
        if log is None:
            return 0
        roll_log(self.spark, f"{self.path}/commits")
        kept = self._log().select("version").orderBy(F.desc("version")).limit(max(1, keep_versions)).agg(F.min("version")).first()[0]
        view, data, deleted = self.view(kept), f"{self.path}/data", 0
        for load in sub_folders(self.spark, data):
            number = int(load.rpartition("=")[2])
            buckets = [b for b in sub_folders(self.spark, f"{data}/{load}") if b.startswith(BUCKET)] if number < view.version else []
            old = [b for b in buckets if number < view.since.get(int(b.rpartition("=")[2]), view.base)]
            deleted += sum(delete_path(self.spark, f"{data}/{load}/{b}") for b in old)
            if old and len(old) == len(buckets):
                delete_path(self.spark, f"{data}/{load}")
        return deleted
