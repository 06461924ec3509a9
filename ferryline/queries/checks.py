"""Key rules, row rules and the comparison of declared schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryline.operators import keys as K
from ferryline.operators import rows as R
from ferryline.operators import schema_diff as D
from ferryline.operators.edges import expected_foreign_keys
from ferryline.plans.contract import columns
from ferryline.queries import query
from ferryline.sources.tables import scan


@query("pk_duplicates", """
    SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1
""")
def pk_duplicates(spark, d):
    return K.key_duplicates(scan(spark, "lineitem", d), ["l_orderkey", "l_linenumber"])


@query("unique_duplicates", """
    SELECT md5(text) AS text_md5, n_rows FROM (
        SELECT text, count(*) AS n_rows FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)
""")
def unique_duplicates(spark, d):
    found = K.key_duplicates(scan(spark, "documents", d), ["text"])
    return found.select(F.md5("text").alias("text_md5"), "n_rows")


# Orders whose customer was not taken over, because the load kept one condition.
@query("fk_orphans", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
""")
def fk_orphans(spark, d):
    parents = scan(spark, "orders", d).where("o_orderstatus <> 'P'")
    lost = K.orphans(scan(spark, "lineitem", d), parents, "l_orderkey", "o_orderkey")
    return lost.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("fk_orphan_counts", """
    SELECT o_custkey, count(*) AS n_rows FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey
""")
def fk_orphan_counts(spark, d):
    parents = scan(spark, "customer", d).where("c_acctbal > 0")
    return K.orphan_counts(scan(spark, "orders", d), parents, "o_custkey", "c_custkey")


@query("simple_unique_cols", """
    WITH entries AS (
        SELECT 't' || l_partkey AS table_id, 'c' || l_linenumber AS col,
               CASE WHEN l_returnflag = 'N' THEN 'unnamed_c' || l_linenumber ELSE 'ix' || l_suppkey END AS ix
        FROM lineitem WHERE l_linestatus = 'F')
    SELECT DISTINCT table_id, min(col) AS column_name FROM entries GROUP BY table_id, ix HAVING count(DISTINCT col) = 1
""")
def simple_unique_cols(spark, d):
    rows = scan(spark, "lineitem", d).select(
        F.concat(F.lit("t"), "l_partkey").alias("table_id"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("IX"), "l_suppkey")).otherwise(F.lit(" ")).alias("index_name"),
        F.concat(F.lit("C"), "l_linenumber").alias("column_name"),
        (F.col("l_linestatus") != "F").alias("non_unique"),
    )
    return K.simple_unique_columns(rows)


# --- rules on rows -----------------------------------------------------------


def _part_target() -> R.TargetSchema:
    ddl = """p_partkey int, p_name varchar(9), p_brand int, p_type string NOT NULL, p_size tinyint,
             p_retailprice decimal(5,2)"""
    return R.TargetSchema(columns(ddl), primary_key=["p_partkey"])


def _parts(spark, d):
    """Parts as a source with wider types than the target: one type is missing, brands are not numbers."""
    return scan(spark, "part", d).select(
        "p_partkey", "p_name",
        F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(F.regexp_replace("p_brand", "Brand#", "")).alias("p_brand"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("p_type"),
        (F.col("p_size") * 4).alias("p_size"), "p_retailprice",
    )


@query("row_violations", """
    SELECT CAST(p_partkey AS INTEGER) AS p_partkey, column_name, rule FROM (
    SELECT p_partkey, 'p_name' AS column_name, 'too_long' AS rule FROM part WHERE length(p_name) > 9
    UNION ALL SELECT p_partkey, 'p_brand', 'bad_cast' FROM part WHERE p_size > 40
    UNION ALL SELECT p_partkey, 'p_type', 'not_null' FROM part WHERE p_type = 'PROMO'
    UNION ALL SELECT p_partkey, 'p_size', 'overflow' FROM part WHERE p_size * 4 > 127
    UNION ALL SELECT p_partkey, 'p_retailprice', 'overflow' FROM part WHERE round(p_retailprice, 2) >= 1000)
""")
def row_violations(spark, d):
    return R.row_violations(_parts(spark, d), _part_target(), ["p_partkey"])


@query("split_rejects", """
    SELECT CAST(p_partkey AS INTEGER) AS p_partkey, length(p_name) > 9 OR p_size > 40 OR p_type = 'PROMO' OR p_size * 4 > 127
                      OR round(p_retailprice, 2) >= 1000 AS rejected
    FROM part
""")
def split_rejects(spark, d):
    good, rejects = R.split_rejects(_parts(spark, d), _part_target())
    return good.select("p_partkey", F.lit(False).alias("rejected")).union(
        rejects.select("p_partkey", F.lit(True).alias("rejected"))
    )


# --- declared schemas --------------------------------------------------------
# A catalog with one table per part and one column per line number.  The source
# describes the returned lines, the target what was shipped from 1996 on; parts
# of size 50 have no target.

CATALOG_SQL = """
    catalog AS (
        SELECT l_partkey AS t, 'c' || l_linenumber AS c,
               max(CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 12 ELSE 93 END) FILTER (l_linestatus = 'F') AS st,
               max(CAST(l_quantity AS INTEGER)) FILTER (l_linestatus = 'F') AS ss,
               bool_or(l_discount > 0.05) FILTER (l_linestatus = 'F') AS sn,
               max(CASE l_returnflag WHEN 'A' THEN -5 WHEN 'N' THEN 12 ELSE 91 END)
                   FILTER (l_shipdate >= TIMESTAMP '1998-01-01 00:00:00') AS tt,
               max(CAST(l_quantity AS INTEGER)) FILTER (l_shipdate >= TIMESTAMP '1998-01-01 00:00:00') AS ts,
               bool_or(l_discount > 0.05) FILTER (l_shipdate >= TIMESTAMP '1998-01-01 00:00:00') AS tn
        FROM lineitem GROUP BY ALL),
    pairs AS (
        SELECT 's' || t AS source_id, 't' || t AS target_id, c AS column_name, st, ss, sn, tt, ts, tn,
               CASE st WHEN 4 THEN 'NUMERIC' WHEN 12 THEN 'TEXT' ELSE 'TEMPORAL' END AS sf,
               CASE tt WHEN -5 THEN 'NUMERIC' WHEN 12 THEN 'TEXT' WHEN 91 THEN 'TEMPORAL' END AS tf
        FROM catalog JOIN part ON p_partkey = t WHERE st IS NOT NULL)
"""


def _codes(numeric: int, temporal: int):
    return F.when(F.col("l_returnflag") == "A", numeric).when(F.col("l_returnflag") == "N", 12).otherwise(temporal)


def _catalog(lines, prefix: str, case, numeric: int, temporal: int):
    return lines.groupBy(F.concat(F.lit(prefix), "l_partkey").alias("table_id"), "l_linenumber").agg(
        F.max(_codes(numeric, temporal)).alias("jdbc_type"),
        F.max(F.col("l_quantity").cast("int")).alias("size"),
        F.bool_or(F.col("l_discount") > 0.05).alias("nullable"),
    ).withColumn("column_name", F.concat(F.lit(case), "l_linenumber")).drop("l_linenumber")


def _catalogs(spark, d):
    lines = scan(spark, "lineitem", d)
    source = _catalog(lines.where("l_linestatus = 'F'"), "s", "C", 4, 93)
    target = _catalog(lines.where("l_shipdate >= '1998-01-01'"), "t", "c", -5, 91)
    return source, target


def _mapping(spark, d):
    name = F.concat(F.lit("t"), "p_partkey")
    return scan(spark, "part", d).select(
        F.col("p_partkey").alias("ordinal"), F.concat(F.lit("s"), "p_partkey").alias("source_id"),
        name.alias("target_id"), F.when(F.col("p_size") < 40, F.lit("Core")).alias("target_schema"),
        F.upper(name).alias("target_table"),
    )


def _column_rule(rule: str, condition: str) -> None:
    @query(f"diff_{rule}", f"""
        WITH {CATALOG_SQL}
        SELECT source_id, target_id, column_name FROM pairs WHERE {condition}
    """)
    def diff(spark, d):
        source, target = _catalogs(spark, d)
        found = D.column_diff(_mapping(spark, d), source, target)
        return found.where(F.col("rule") == names[rule]).select("source_id", "target_id", "column_name")


names = {"missing_column": "missing_column", "type": "type_mismatch", "length": "too_short", "nullability": "nullability"}
_column_rule("missing_column", "tt IS NULL")
_column_rule("type", "sf <> tf")
_column_rule("length", "sf = 'TEXT' AND ts < ss AND tt IS NOT NULL")
_column_rule("nullability", "sn <> tn AND tt IS NOT NULL")


@query("diff_missing_table", """
    SELECT DISTINCT 't' || p_partkey AS table_id, 'target' AS side FROM part
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '2001-01-01 00:00:00'
                      AND l_returnflag = 'R')
""")
def diff_missing_table(spark, d):
    late = scan(spark, "lineitem", d).where("l_shipdate >= '2001-01-01' AND l_returnflag = 'R'")
    return D.missing_tables(_mapping(spark, d), _catalog(late, "t", "c", -5, 91), "target")


@query("diff_primary_key", """
    SELECT DISTINCT 's' || l_partkey AS source_id, 't' || l_partkey AS target_id, 'c' || l_linenumber AS column_name
    FROM lineitem s WHERE l_linestatus = 'F' AND NOT EXISTS (
        SELECT 1 FROM lineitem t WHERE t.l_partkey = s.l_partkey AND t.l_linenumber = s.l_linenumber
                                   AND t.l_shipdate >= TIMESTAMP '1999-01-01 00:00:00')
""")
def diff_primary_key(spark, d):
    lines = scan(spark, "lineitem", d)

    def key_columns(rows, prefix, case):
        return rows.select(F.concat(F.lit(prefix), "l_partkey").alias("table_id"),
                           F.concat(F.lit(case), "l_linenumber").alias("column_name"))

    source = key_columns(lines.where("l_linestatus = 'F'"), "s", "C")
    target = key_columns(lines.where("l_shipdate >= '1999-01-01'"), "t", "c")
    return D.primary_key_diff(_mapping(spark, d), source, target)


# Foreign keys: part l_partkey has a key on column l_linenumber to the part numbered l_suppkey.


def _fk_rows(lines, prefix: str, schema, table):
    return lines.select(
        F.concat(F.lit(prefix), "l_partkey").alias("table_id"),
        F.struct("l_orderkey", "l_suppkey", "l_shipdate", "l_quantity").alias("ordinal"),
        F.concat(F.lit("c"), "l_linenumber").alias("column_name"),
        schema.alias("ref_schema"), table.alias("ref_table"),
        F.concat(F.lit("s"), "l_suppkey").alias("ref_id"), F.lit("id").alias("ref_column"),
    )


@query("fk_expected", """
    SELECT 's' || l_partkey AS table_id, 'c' || l_linenumber AS column_name, 's' || l_suppkey AS ref,
           CASE WHEN p_size < 40 THEN 'Core' END AS expected_schema, 'T' || l_suppkey AS expected_table
    FROM lineitem JOIN part ON p_partkey = l_suppkey AND p_type <> 'PROMO' WHERE l_returnflag = 'R'
""")
def fk_expected(spark, d):
    lines = scan(spark, "lineitem", d).where("l_returnflag = 'R'")
    kept = scan(spark, "part", d).where("p_type <> 'PROMO'").select(F.concat(F.lit("s"), "p_partkey").alias("source_id"))
    mapping = _mapping(spark, d).join(kept, "source_id", "left_semi")
    fks = _fk_rows(lines, "s", F.lit("public"), F.col("l_suppkey").cast("string"))
    fks = fks.withColumn("ref", F.col("ref_id")).withColumn("ref_column", F.col("ref"))
    return expected_foreign_keys(fks, mapping).select(
        "table_id", "column_name", F.col("ref_column").alias("ref"), "expected_schema", "expected_table"
    )


@query("diff_foreign_key", """
    WITH wanted AS (
        SELECT 's' || l_partkey AS source_id, 't' || l_partkey AS target_id, 'c' || l_linenumber AS column_name,
               'T' || l_suppkey AS expected_table, l_suppkey, m.p_size < 40 AS in_core
        FROM lineitem JOIN part m ON m.p_partkey = l_suppkey WHERE l_returnflag = 'R'),
    have AS (
        SELECT 't' || l_partkey AS target_id, 'c' || l_linenumber AS column_name, l_suppkey AS actual, l_tax > 0.04 AS core,
               row_number() OVER (PARTITION BY l_partkey, l_linenumber
                                  ORDER BY l_orderkey, l_suppkey, l_shipdate, l_quantity) AS rn
        FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00')
    SELECT source_id, w.target_id, w.column_name, expected_table, 'id' AS expected_column,
           CASE WHEN actual IS NULL THEN 'absent' ELSE 'different' END AS problem
    FROM wanted w LEFT JOIN have h ON h.target_id = w.target_id AND h.column_name = w.column_name AND rn = 1
    WHERE actual IS NULL OR actual <> l_suppkey OR (in_core AND NOT core)
""")
def diff_foreign_key(spark, d):
    lines = scan(spark, "lineitem", d)
    name = F.concat(F.lit("t"), "l_suppkey")
    source = _fk_rows(lines.where("l_returnflag = 'R'"), "s", F.lit("public"), name)
    schema = F.when(F.col("l_tax") > 0.04, "core").otherwise("public")
    target = _fk_rows(lines.where("l_shipdate >= '1996-01-01'"), "t", schema, name)
    return D.foreign_key_diff(_mapping(spark, d), source, target)


@query("diff_unique", """
    WITH entries AS (
        SELECT l_partkey AS t, 'c' || l_linenumber AS col, l_suppkey AS ix, l_linestatus = 'F' AS in_source,
               l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AS in_target FROM lineitem),
    source AS (SELECT DISTINCT t, min(col) AS col FROM entries WHERE in_source GROUP BY t, ix HAVING count(DISTINCT col) = 1),
    target AS (SELECT DISTINCT t, min(col) AS col FROM entries WHERE in_target GROUP BY t, ix HAVING count(DISTINCT col) = 1)
    SELECT 's' || t AS source_id, 't' || t AS target_id, col AS column_name FROM (
        SELECT * FROM source EXCEPT SELECT * FROM target)
""")
def diff_unique(spark, d):
    lines = scan(spark, "lineitem", d)

    def index_rows(rows, prefix):
        return rows.select(F.concat(F.lit(prefix), "l_partkey").alias("table_id"),
                           F.concat(F.lit("ix"), "l_suppkey").alias("index_name"),
                           F.concat(F.lit("C"), "l_linenumber").alias("column_name"), F.lit(False).alias("non_unique"))

    source = index_rows(lines.where("l_linestatus = 'F'"), "s")
    target = index_rows(lines.where("l_shipdate >= '1997-01-01'"), "t")
    return D.unique_diff(_mapping(spark, d), source, target)
