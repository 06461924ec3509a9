"""Catalog frames: columns and constraints of declared target schemas, and of databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.functions.types import jdbc_code
from ferryline.operators.rows import TargetSchema
from ferryline.sources.jdbc import Connection, jdbc_query

COLUMNS = "table_id string, column_name string, jdbc_type int, type_name string, size int, nullable boolean"
PRIMARY_KEYS = "table_id string, column_name string"
FOREIGN_KEYS = """table_id string, ordinal int, column_name string, ref_schema string, ref_table string,
                  ref_id string, ref_column string"""
INDEX_ROWS = "table_id string, index_name string, column_name string, non_unique boolean"


def _size(data_type: T.DataType) -> int | None:
    return data_type.length if isinstance(data_type, (T.CharType, T.VarcharType)) else None


def declared_catalog(spark: SparkSession, tables: dict[str, TargetSchema]) -> dict[str, DataFrame]:
    """The four catalog frames of schemas held in a contract, by table id."""
    columns, primary, foreign, unique = [], [], [], []
    for table_id, schema in tables.items():
        for f in schema.columns:
            nullable = f.nullable and f.name not in schema.primary_key
            kind = f.dataType.simpleString()
            columns.append((table_id, f.name, jdbc_code(f.dataType), kind, _size(f.dataType), nullable))
        primary += [(table_id, name) for name in schema.primary_key]
        unique += [(table_id, f"unique_{name}", name, False) for name in schema.unique]
        unique += [(table_id, "primary", name, False) for name in schema.primary_key]
        for i, fk in enumerate(schema.foreign_keys):
            ref_schema, _, ref_table = fk.parent.partition(".")
            foreign.append((table_id, i, fk.column, ref_schema, ref_table, fk.parent, fk.parent_column))
    return {
        "columns": spark.createDataFrame(columns, COLUMNS),
        "primary_keys": spark.createDataFrame(primary, PRIMARY_KEYS),
        "foreign_keys": spark.createDataFrame(foreign, FOREIGN_KEYS),
        "index_rows": spark.createDataFrame(unique, INDEX_ROWS),
    }


# JDBC codes of the type names in an information schema.
TYPE_NAMES = {
    "smallint": 5, "integer": 4, "bigint": -5, "real": 7, "double precision": 8, "numeric": 2, "decimal": 3,
    "character": 1, "character varying": 12, "varchar": 12, "text": 12, "date": 91, "time without time zone": 92,
    "timestamp": 93, "timestamp without time zone": 93, "timestamp with time zone": 93, "boolean": -7, "bytea": -2,
}

TABLE_ID = "LOWER({0}.table_schema || '.' || {0}.table_name)"
COLUMNS_QUERY = f"""
    SELECT {TABLE_ID.format('c')} AS table_id, c.column_name, LOWER(c.data_type) AS type_name,
           c.character_maximum_length AS size, c.is_nullable
    FROM information_schema.columns c
    WHERE c.table_schema <> 'information_schema' AND c.table_schema <> 'pg_catalog'
"""
KEYS_QUERY = f"""
    SELECT {TABLE_ID.format('k')} AS table_id, k.constraint_name AS index_name, k.column_name, t.constraint_type
    FROM information_schema.table_constraints t
    JOIN information_schema.key_column_usage k
      ON k.constraint_schema = t.constraint_schema AND k.constraint_name = t.constraint_name
     AND k.table_name = t.table_name
    WHERE t.constraint_type = 'PRIMARY KEY' OR t.constraint_type = 'UNIQUE'
"""
FOREIGN_KEYS_QUERY = f"""
    SELECT {TABLE_ID.format('f')} AS table_id, f.constraint_name AS fk_name, f.ordinal_position AS ordinal,
           f.table_schema AS fk_schema, f.table_name AS fk_table, f.column_name,
           p.table_schema AS ref_schema, p.table_name AS ref_table, {TABLE_ID.format('p')} AS ref_id,
           p.column_name AS ref_column
    FROM information_schema.referential_constraints r
    JOIN information_schema.table_constraints t
      ON t.constraint_schema = r.constraint_schema AND t.constraint_name = r.constraint_name
     AND t.constraint_type = 'FOREIGN KEY'
    JOIN information_schema.key_column_usage f
      ON f.constraint_schema = t.constraint_schema AND f.constraint_name = t.constraint_name
     AND f.table_schema = t.table_schema AND f.table_name = t.table_name
    JOIN information_schema.key_column_usage p
      ON p.constraint_schema = r.unique_constraint_schema AND p.constraint_name = r.unique_constraint_name
     AND p.ordinal_position = f.position_in_unique_constraint
"""


def database_catalog(spark: SparkSession, connection: Connection) -> dict[str, DataFrame]:
    """The four catalog frames of a database with an information schema."""
    columns = jdbc_query(spark, connection, COLUMNS_QUERY)
    keys = jdbc_query(spark, connection, KEYS_QUERY)
    codes = F.create_map(*[F.lit(part) for pair in TYPE_NAMES.items() for part in pair])
    return {
        "columns": columns.select(
            "table_id", "column_name", F.coalesce(F.try_element_at(codes, "type_name"), F.lit(1111)).alias("jdbc_type"),
            "type_name", F.col("size").cast("int"), (F.upper("is_nullable") == "YES").alias("nullable")),
        "primary_keys": keys.where("constraint_type = 'PRIMARY KEY'").select("table_id", "column_name"),
        "foreign_keys": jdbc_query(spark, connection, FOREIGN_KEYS_QUERY).drop("fk_schema", "fk_table", "fk_name"),
        "index_rows": keys.select("table_id", "index_name", "column_name", F.lit(False).alias("non_unique")),
    }


def database_foreign_keys(spark: SparkSession, connection: Connection) -> DataFrame:
    """Foreign-key rows of a database, as `migrate` takes them."""
    keys = jdbc_query(spark, connection, FOREIGN_KEYS_QUERY)
    return keys.select(F.col("ref_schema").alias("pk_schema"), F.col("ref_table").alias("pk_table"), "fk_schema", "fk_table")


def database_self_references(spark: SparkSession, connection: Connection) -> DataFrame:
    """Foreign-key rows of a database, as `operators.edges.self_references` takes them."""
    keys = jdbc_query(spark, connection, FOREIGN_KEYS_QUERY)
    return keys.select("table_id", "ref_id", "fk_name", F.col("column_name").alias("fk_column"),
                       F.col("ref_column").alias("pk_column"))
