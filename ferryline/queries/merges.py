"""Append and upsert, as DataFrames and through the versioned target.

The targets stand for what an earlier load left: rows up to some date, some of
them with values that have changed since.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryline.operators import merge as M
from ferryline.queries import query
from ferryline.session import new_folder
from ferryline.sources.buckets import BucketedTable
from ferryline.sources.tables import VersionedTable, scan


def versioned(spark, label: str, like, keys=None) -> VersionedTable:
    """A new, empty target for rows shaped like `like`."""
    return VersionedTable(spark, new_folder(spark, label), like.schema, keys)


def _publish(table: VersionedTable, staged, run_id: str):
    table.publish(staged, run_id)
    return table


@query("load_append", """
    SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'
    UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F'
""")
def load_append(spark, d):
    orders = scan(spark, "orders", d)
    table = versioned(spark, "append", orders)
    _publish(table, table.stage_append(orders.where("o_orderdate < '1998-01-01'")), "first")
    _publish(table, table.stage_append(orders.where("o_orderstatus = 'F'")), "second")
    return table.read()


@query("load_upsert", """
    SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, c_mktsegment
    FROM customer WHERE c_acctbal >= 0 OR c_mktsegment <> 'BUILDING'
""")
def load_upsert(spark, d):
    customer = scan(spark, "customer", d)
    table = versioned(spark, "upsert", customer, ["c_custkey"])
    old = customer.where("c_mktsegment <> 'BUILDING'").withColumn("c_acctbal", F.lit(None).cast("double"))
    _publish(table, table.stage_upsert(old), "first")
    _publish(table, table.stage_upsert(customer.where("c_acctbal >= 0")), "second")
    return table.read()


@query("merge_upsert", """
    SELECT * REPLACE (CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' THEN o_orderpriority ELSE 'OLD' END
                      AS o_orderpriority)
    FROM orders
""")
def merge_upsert(spark, d):
    orders = scan(spark, "orders", d)
    target = orders.where("o_orderdate < '1999-01-01'").withColumn("o_orderpriority", F.lit("OLD"))
    return M.merge_upsert(target, orders.where("o_orderdate >= '1997-01-01'"), ["o_orderkey"])


LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]
LINE_KEY = ["l_orderkey", "l_linenumber"]
LATEST_LINE = """
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,
                     l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn
        FROM lineitem WHERE {where}) WHERE rn = 1
"""


@query("latest_per_key", LATEST_LINE.format(where="true"))
def latest_per_key(spark, d):
    return M.latest_per_key(scan(spark, "lineitem", d), LINE_KEY, LINE_ORDER)


@query("merge_composite_key", f"""
    WITH source AS ({LATEST_LINE.format(where="l_linestatus = 'F'")}),
         target AS ({LATEST_LINE.format(where="l_linestatus = 'O'")})
    SELECT * FROM source
    UNION ALL SELECT * FROM target t WHERE NOT EXISTS (
        SELECT 1 FROM source s WHERE s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber)
""")
def merge_composite_key(spark, d):
    lines = scan(spark, "lineitem", d)
    target = M.latest_per_key(lines.where("l_linestatus = 'O'"), LINE_KEY, LINE_ORDER)
    return M.merge_upsert(target, lines.where("l_linestatus = 'F'"), LINE_KEY, LINE_ORDER)


@query("merge_bucketed", f"""
    WITH source AS ({LATEST_LINE.format(where="l_linestatus = 'F'")}),
         target AS ({LATEST_LINE.format(where="l_linestatus = 'O'")})
    SELECT * FROM source
    UNION ALL SELECT * FROM target t WHERE NOT EXISTS (
        SELECT 1 FROM source s WHERE s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber)
""")
def merge_bucketed(spark, d):
    """The merge of `merge_composite_key` into a table in buckets of its key."""
    lines = scan(spark, "lineitem", d)
    table = BucketedTable(spark, new_folder(spark, "bucketed"), lines.schema, LINE_KEY, buckets=8)
    table.upsert(lines.where("l_linestatus = 'O'"), "first", LINE_ORDER)
    table.upsert(lines.where("l_linestatus = 'F'"), "second", LINE_ORDER)
    return table.read()


@query("merge_null_keys", """
    WITH source AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS custkey,
                           o_orderkey AS last_order FROM orders),
         latest AS (SELECT custkey, max(last_order) AS last_order FROM source WHERE custkey IS NOT NULL GROUP BY 1)
    SELECT * FROM latest
    UNION ALL SELECT * FROM source WHERE custkey IS NULL
    UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT custkey FROM latest)
""")
def merge_null_keys(spark, d):
    target = scan(spark, "customer", d).select(F.col("c_custkey").alias("custkey"), F.lit(-1).cast("bigint").alias("last_order"))
    source = scan(spark, "orders", d).select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("custkey"), F.col("o_orderkey").alias("last_order")
    )
    return M.merge_upsert(target, source, ["custkey"], ["last_order"])


@query("merge_changes", """
    SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01 00:00:00' THEN 'insert'
                            WHEN o_orderstatus = 'F' THEN 'update' ELSE 'unchanged' END AS change
    FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'
""")
def merge_changes(spark, d):
    orders = scan(spark, "orders", d)
    price = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    target = orders.where("o_orderdate < '1999-01-01'").withColumn("o_totalprice", price)
    changes = M.merge_changes(target, orders.where("o_orderdate >= '1997-01-01'"), ["o_orderkey"])
    return changes.select("o_orderkey", "change")
