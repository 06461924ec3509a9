"""Declared schemas of source and target compared set-wise, for any number of tables.

Catalog inputs, one row per item:
    columns        table_id, column_name, jdbc_type, size, nullable
    primary_keys   table_id, column_name
    foreign_keys   table_id, ordinal, column_name, ref_schema, ref_table, ref_id, ref_column
    index_rows     table_id, index_name, column_name, non_unique
    mapping        ordinal, source_id, target_id, target_schema, target_table
Every function returns the violations it found, one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ferryline.functions import ids
from ferryline.functions.types import type_family
from ferryline.operators.edges import expected_foreign_keys
from ferryline.operators.keys import simple_unique_columns


def missing_tables(mapping: DataFrame, columns: DataFrame, side: str) -> DataFrame:
    """Mapped tables without a single column; `side` is "source" or "target"."""
    wanted = mapping.select(F.col(f"{side}_id").alias("table_id")).distinct()
    return wanted.join(columns.select("table_id").distinct(), "table_id", "left_anti").withColumn("side", F.lit(side))


def column_diff(mapping: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Column rules in one pass: missing_column, type_mismatch, too_short, nullability.

    Of one column the rules are read in this order and a missing column breaks no other.
    """
    pairs = mapping.select("source_id", "target_id")
    wanted = source.join(pairs, F.col("table_id") == F.col("source_id")).select(
        "source_id", "target_id", F.lower("column_name").alias("column_name"),
        F.col("jdbc_type").alias("source_type"), F.col("size").alias("source_size"),
        F.coalesce("nullable", F.lit(False)).alias("source_nullable"),
    )
    have = target.select(
        F.col("table_id").alias("target_id"), F.lower("column_name").alias("column_name"),
        F.col("jdbc_type").alias("target_type"), F.col("size").alias("target_size"),
        F.coalesce("nullable", F.lit(False)).alias("target_nullable"), F.lit(True).alias("found"),
    )
    family = type_family(F.col("source_type"))
    same_family = family == type_family(F.col("target_type"))
    short = family.isin("TEXT", "BINARY") & (F.col("target_size") < F.col("source_size"))
    nullability = F.col("source_nullable") != F.col("target_nullable")
    rules = F.when(F.col("found").isNull(), F.array(F.lit("missing_column"))).otherwise(
        F.array_compact(F.array(
            F.when(~same_family, "type_mismatch"), F.when(short, "too_short"), F.when(nullability, "nullability"),
        ))
    )
    both = wanted.join(have, ["target_id", "column_name"], "left")
    return both.select("source_id", "target_id", "column_name", F.explode(rules).alias("rule"))


def primary_key_diff(mapping: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Primary-key columns of a source that are not in its target's primary key."""
    pairs = mapping.select("source_id", "target_id")
    wanted = source.join(pairs, F.col("table_id") == F.col("source_id")).select(
        "source_id", "target_id", F.lower("column_name").alias("column_name")
    )
    have = target.select(F.col("table_id").alias("target_id"), F.lower("column_name").alias("column_name")).distinct()
    return wanted.distinct().join(have, ["target_id", "column_name"], "left_anti")


def foreign_key_diff(mapping: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Foreign keys whose target counterpart is absent or points elsewhere.

    The counterpart is the first foreign key of the target table on that column;
    the schema is compared only where the expected table names one.
    """
    pairs = mapping.select("source_id", "target_id")
    wanted = expected_foreign_keys(source, mapping).join(pairs, F.col("table_id") == F.col("source_id"))
    wanted = wanted.select(
        "source_id", "target_id", ids.normalize(F.col("column_name")).alias("column_name"),
        "expected_schema", "expected_table", F.col("ref_column").alias("expected_column"),
    )
    first = W.partitionBy("target_id", "column_name").orderBy("ordinal")
    have = target.select(
        F.col("table_id").alias("target_id"), ids.normalize(F.col("column_name")).alias("column_name"),
        "ordinal", "ref_schema", "ref_table", "ref_column",
    )
    have = have.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank", "ordinal")

    def same(left: str, right: str):
        return ids.normalize(F.col(left)) == ids.normalize(F.col(right))

    matches = (
        same("ref_table", "expected_table")
        & same("ref_column", "expected_column")
        & (ids.is_blank(F.col("expected_schema")) | same("ref_schema", "expected_schema"))
    )
    both = wanted.join(have, ["target_id", "column_name"], "left").where(~F.coalesce(matches, F.lit(False)))
    problem = F.when(F.col("ref_table").isNull(), "absent").otherwise("different")
    return both.select(
        "source_id", "target_id", "column_name", F.col("expected_table"), "expected_column", problem.alias("problem")
    )


def unique_diff(mapping: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Columns unique on their own in a source but not in its target."""
    pairs = mapping.select("source_id", "target_id")
    wanted = simple_unique_columns(source).join(pairs, F.col("table_id") == F.col("source_id"))
    have = simple_unique_columns(target).withColumnRenamed("table_id", "target_id")
    return wanted.select("source_id", "target_id", "column_name").join(have, ["target_id", "column_name"], "left_anti")


def schema_diff(mapping: DataFrame, source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """All violations of all mapped tables: (source_id, target_id, column_name, rule).

    `source` and `target` hold the catalog frames columns, primary_keys,
    foreign_keys and index_rows.
    """
    layout = ["source_id", "target_id", "column_name", "rule"]
    none = F.lit(None).cast("string")

    def tables(side: str, catalog: dict[str, DataFrame]) -> DataFrame:
        found = missing_tables(mapping, catalog["columns"], side).withColumnRenamed("table_id", f"{side}_id")
        return found.join(mapping.select("source_id", "target_id"), f"{side}_id").select(
            "source_id", "target_id", none.alias("column_name"), F.lit(f"missing_{side}_table").alias("rule")
        )

    def rule(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("rule", F.lit(name)).select(*layout)

    return (
        tables("source", source)
        .union(tables("target", target))
        .union(column_diff(mapping, source["columns"], target["columns"]).select(*layout))
        .union(rule(primary_key_diff(mapping, source["primary_keys"], target["primary_keys"]), "primary_key"))
        .union(rule(foreign_key_diff(mapping, source["foreign_keys"], target["foreign_keys"]), "foreign_key"))
        .union(rule(unique_diff(mapping, source["index_rows"], target["index_rows"]), "unique"))
    )
