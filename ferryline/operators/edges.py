"""Dependency edges between tables, one row per edge (parent, child).

Lists of parents are kept as rows, never gathered into arrays, so a table with
very many parents or children costs no single task more than its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ferryline.functions import ids


def _last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    newest = W.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def _only(edges: DataFrame, column: str, included: DataFrame) -> DataFrame:
    nodes = included.select(F.col(included.columns[0]).alias("_id"))
    return edges.join(nodes, F.col(column) == F.col("_id"), "left_semi")


def clean_edges(edges: DataFrame, included: DataFrame) -> DataFrame:
    """Distinct (parent, child) in normal form with both ends included; no self edges.

    A blank identifier is an error.
    """
    named = edges.select(
        ids.normalize_id(F.col("parent")).alias("parent"), ids.normalize_id(F.col("child")).alias("child")
    )
    nodes = included.select(ids.normalize_id(F.col(included.columns[0])).alias("id"))
    return _only(_only(named.where("parent <> child").distinct(), "parent", nodes), "child", nodes)


def ordered_names(nodes: DataFrame) -> DataFrame:
    """Distinct table names in normal form, in the order used wherever order is free."""
    return nodes.select(ids.normalize_id(F.col(nodes.columns[0])).alias("id")).distinct().orderBy("id")


def included_edges(fk_rows: DataFrame, included: DataFrame) -> DataFrame:
    """Edges of foreign-key catalog rows (pk_schema, pk_table, fk_schema, fk_table) within a set of table ids."""
    edges = fk_rows.select(
        ids.table_id(F.col("pk_schema"), F.col("pk_table")).alias("parent"),
        ids.table_id(F.col("fk_schema"), F.col("fk_table")).alias("child"),
    )
    return clean_edges(edges, included)


def map_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between source ids as edges between contract keys.

    `mapping` has (ordinal, source_id, contract_key); of two entries with one
    source the later wins.  An edge with an unmapped end drops out.
    """
    names = _last_wins(mapping, "source_id", "ordinal").select("source_id", "contract_key")
    parents = names.select(F.col("source_id").alias("parent"), ids.normalize(F.col("contract_key")).alias("_parent"))
    children = names.select(F.col("source_id").alias("child"), ids.normalize(F.col("contract_key")).alias("_child"))
    mapped = edges.join(parents, "parent").join(children, "child")
    return mapped.select(F.col("_parent").alias("parent"), F.col("_child").alias("child"))


def expected_foreign_keys(source_fks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Source foreign keys with the referenced table replaced by that table's target.

    `source_fks` has (table_id, column_name, ref_id, ref_column); `mapping` has
    (ordinal, source_id, target_schema, target_table).  A key to a table that is
    not migrated is left out.
    """
    targets = _last_wins(mapping, "source_id", "ordinal").select(
        F.col("source_id").alias("ref_id"),
        F.col("target_schema").alias("expected_schema"),
        F.col("target_table").alias("expected_table"),
    )
    return source_fks.join(targets, "ref_id").select(
        "table_id", "column_name", "expected_schema", "expected_table", "ref_column"
    )


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct parents of each node; zero for a root."""
    counts = edges.distinct().groupBy("child").agg(F.count("*").alias("n_parents"))
    return nodes.join(counts, F.col("id") == F.col("child"), "left").select(
        "id", F.coalesce("n_parents", F.lit(0)).alias("n_parents")
    )


def dependency_analysis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each table with its parents, one row per parent; an independent table has one row and no parent."""
    parents = edges.where("parent <> child").distinct()
    children = parents.select(F.col("child").alias("id")).distinct()
    # Not one outer join: a table with very many parents would be its unsplittable side.
    dependent = _only(parents, "child", nodes).select(F.col("child").alias("id"), F.lit("dependent").alias("kind"), "parent")
    none = F.lit(None).cast(parents.schema["parent"].dataType).alias("parent")
    independent = nodes.select("id").join(children, "id", "left_anti").select("id", F.lit("independent").alias("kind"), none)
    return dependent.union(independent)


def blocked_by(edges: DataFrame, stopped: DataFrame) -> DataFrame:
    """(table, blocking parent) for every table with a failed or blocked parent."""
    found = _only(edges.where("parent <> child").distinct(), "parent", stopped)
    return found.select(F.col("child").alias("table_id"), F.col("parent").alias("blocked_by"))


def self_references(fk_rows: DataFrame) -> DataFrame:
    """Tables with exactly one foreign key to themselves that has exactly one column.

    `fk_rows` has (table_id, ref_id, fk_name, fk_column, pk_column).
    """
    unnamed = F.concat_ws("->", "fk_column", "pk_column")
    name = F.when(ids.is_blank(F.col("fk_name")), unnamed).otherwise(F.col("fk_name"))
    per_key = (
        fk_rows.where("table_id = ref_id")
        .groupBy("table_id", name.alias("fk_name"))
        .agg(F.count("*").alias("n_columns"), F.min("pk_column").alias("pk_column"), F.min("fk_column").alias("fk_column"))
        .where("n_columns = 1")
    )
    return (
        per_key.groupBy("table_id")
        .agg(F.count("*").alias("n_keys"), F.min("pk_column").alias("pk_column"), F.min("fk_column").alias("fk_column"))
        .where("n_keys = 1")
        .drop("n_keys")
    )


def alias_index(contract: DataFrame) -> DataFrame:
    """Every name a table can be reached by, with its contract key; the first registration wins.

    `contract` has (ordinal, contract_key, source_schema, source_table,
    target_schema, target_table).
    """
    names = F.array(
        F.col("contract_key"),
        F.col("source_table"),
        ids.qualified_name(F.col("source_schema"), F.col("source_table")),
        F.col("target_table"),
        ids.qualified_name(F.col("target_schema"), F.col("target_table")),
    )
    entries = contract.select(
        "ordinal", ids.normalize(F.col("contract_key")).alias("canonical"), F.posexplode(names).alias("pos", "name")
    )
    first = F.min(F.struct("ordinal", "pos", "canonical"))["canonical"]
    return (
        entries.where(~ids.is_blank(F.col("name")))
        .groupBy(ids.normalize(F.col("name")).alias("alias"))
        .agg(first.alias("canonical"))
    )


def distinct_tables(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Number of distinct tables behind a column of names."""
    name = ids.normalize(F.col(names.columns[0]))
    # Distinct first: a name that fills most of the rows is then a single row in the join.
    canonical = names.select(name.alias("alias")).distinct().join(aliases, "alias", "left")
    return canonical.agg(F.countDistinct(F.coalesce("canonical", "alias")).alias("n_tables"))
