"""Key rules as questions about data: duplicates, orphans, unique columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.functions import ids
from ferryline.operators.merge import no_null_key


def key_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row, with the number of rows.

    Counts are summed before the shuffle, so a hot key costs one row per task.
    """
    return (
        df.where(no_null_key(keys)).groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    )


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose foreign key is set but has no parent."""
    parents = parent.select(F.col(pk).alias("_pk")).distinct()
    return child.where(F.col(fk).isNotNull()).join(parents, F.col(fk) == F.col("_pk"), "left_anti")


def orphan_counts(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Missing parents and how many rows point at each.

    Reads only the key columns and counts before it joins: the cheap form of the
    check when the orphan rows themselves are not wanted.
    """
    pointed_at = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count("*").alias("n_rows"))
    return orphans(pointed_at, parent, fk, pk)


def simple_unique_columns(index_rows: DataFrame) -> DataFrame:
    """Columns that alone form a unique index, from rows (table_id, index_name, column_name, non_unique)."""
    column = F.lower("column_name")
    index = F.when(ids.is_blank(F.col("index_name")), F.concat(F.lit("unnamed_"), F.col("column_name"))).otherwise(
        F.col("index_name")
    )
    return (
        index_rows.where(~F.col("non_unique") & ~ids.is_blank(F.col("column_name")))
        .groupBy("table_id", F.lower(index).alias("index_key"))
        .agg(F.min(column).alias("column_name"), F.max(column).alias("last_column"))
        .where("column_name = last_column")
        .select("table_id", "column_name")
        .distinct()
    )
