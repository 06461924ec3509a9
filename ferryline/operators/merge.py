"""Upsert by key as joins over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def clean_keys(keys: list[str] | None) -> list[str]:
    cleaned = [key.strip() for key in keys or [] if key and key.strip()]
    if not cleaned:
        raise ValueError("an upsert needs key columns: none configured and the target has no primary key")
    return cleaned


def no_null_key(keys: list[str]) -> Column:
    return reduce(lambda left, right: left & right, [F.col(key).isNotNull() for key in keys])


def _orderable(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.MapType, T.VariantType))


def latest_per_key(df: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest `order_by`, as if applied in that order.

    All other columns break ties, so a recomputed task picks the same row.
    `row_number() = 1` is limited to one row per key before the shuffle, so a
    hot key arrives as one row per task.
    """
    first = list(order_by or [])
    rest = [f.name for f in df.schema if f.name not in keys and f.name not in first and _orderable(f.dataType)]
    newest = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in first + rest] or [F.lit(1)])
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def without(df: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `df` whose key is not among the keys of `taken`.

    A key with a NULL is never among them.  Such rows bypass the join, where they
    would all meet in one task; parquet statistics skip that branch when there
    are none.
    """
    keyed = taken.where(no_null_key(keys)).select(*keys).distinct()
    free = df.where(no_null_key(keys)).join(keyed, keys, "left_anti").select(*df.columns)
    return free.union(df.where(~no_null_key(keys)))


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str],
                 order_by: list[str] | None = None, keys_set: bool = False) -> DataFrame:
    """`target` after upserting `source`: matched rows replaced, others inserted, none deleted.

    A key with a NULL matches nothing: such rows are inserted as they are.  With
    `keys_set`, where `source` was checked to have none, it is not read for them.
    """
    keys = clean_keys(keys)
    return without(target, source, keys).unionByName(rows_to_write(source, keys, order_by, keys_set))


def merge_newest(target: DataFrame, source: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Like `merge_upsert`, but a target row stays where the source's is older by `order_by`; equally new ones are replaced."""
    keys = clean_keys(keys)
    both = target.withColumn("_incoming", F.lit(0)).unionByName(source.withColumn("_incoming", F.lit(1)))
    newest = latest_per_key(both.where(no_null_key(keys)), keys, [*order_by, "_incoming"])
    return newest.unionByName(both.where(~no_null_key(keys))).drop("_incoming")


def rows_to_write(source: DataFrame, keys: list[str], order_by: list[str] | None = None,
                  keys_set: bool = False) -> DataFrame:
    """What an upsert writes of `source`, read once: the last row of each key, and every row with a NULL in its key.

    Rows with a NULL are given a number each: none is dropped, and they don't meet in one task.
    """
    if keys_set:
        return latest_per_key(source, keys, order_by)
    alone = F.when(~no_null_key(keys), F.monotonically_increasing_id())
    return latest_per_key(source.withColumn("_alone", alone), [*keys, "_alone"], order_by).drop("_alone")


def merge_changes(target: DataFrame, source: DataFrame, keys: list[str],
                  order_by: list[str] | None = None) -> DataFrame:
    """What the upsert will do with each source row: insert, update or unchanged."""
    keys = clean_keys(keys)
    values = [c for c in source.columns if c not in keys]
    old = target.where(no_null_key(keys)).select(*keys, F.struct(*values).alias("_old"), F.lit(True).alias("_found"))
    keyed = latest_per_key(source.where(no_null_key(keys)), keys, order_by).join(old, keys, "left")
    label = (
        F.when(F.col("_found").isNull(), "insert")
        .when(F.struct(*values).eqNullSafe(F.col("_old")), "unchanged")
        .otherwise("update")
    )
    labelled = keyed.withColumn("change", label).drop("_old", "_found")
    return labelled.unionByName(source.where(~no_null_key(keys)).withColumn("change", F.lit("insert")))
