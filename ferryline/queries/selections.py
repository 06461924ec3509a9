"""Scans, filters, cursors and batches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.operators import selection as S
from ferryline.queries import query
from ferryline.sources.state import latest_state
from ferryline.sources.tables import scan


@query("scan_full", "SELECT * FROM orders")
def scan_full(spark, d):
    return scan(spark, "orders", d)


@query("filter_where", """
    SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0
""")
def filter_where(spark, d):
    return S.where(scan(spark, "customer", d), "c_mktsegment = 'BUILDING' OR c_acctbal < 0")


@query("cursor_filter", """
    SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00'
""")
def cursor_filter(spark, d):
    rows = S.after_cursor(scan(spark, "events", d), "ts", "2024-01-15 12:00:00")
    return S.project(rows, ["event_id", "ts", "user_id", "event_type", "value"])


@query("cursor_and_filter", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
    WHERE o_orderdate > TIMESTAMP '1998-06-01 00:00:00' AND (o_orderstatus = 'F' OR o_totalprice > 400000)
""")
def cursor_and_filter(spark, d):
    rows = S.after_cursor(scan(spark, "orders", d), "o_orderdate", "1998-06-01 00:00:00")
    rows = S.where(rows, "o_orderstatus = 'F' OR o_totalprice > 400000")
    return S.project(rows, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])


@query("project_columns", "SELECT p_partkey, p_brand, p_size FROM part")
def project_columns(spark, d):
    return S.project(scan(spark, "part", d), ["p_partkey", "p_brand", "p_size"])


# The saved cursor of a customer is the date of its last order.
STATE_SQL = """
    SELECT state_key, last_value, order_key FROM (
        SELECT o_custkey AS state_key, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS last_value,
               o_orderkey AS order_key,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM orders) WHERE rn = 1
"""


def _saved_cursors(spark, d):
    records = scan(spark, "orders", d).select(
        F.col("o_custkey").alias("state_key"),
        F.col("o_orderdate").cast("date").cast("string").alias("last_value"),
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderdate").alias("updated_at"),
    )
    return latest_state(records, tie_break=["order_key"])


@query("state_latest", STATE_SQL)
def state_latest(spark, d):
    return _saved_cursors(spark, d).select("state_key", "last_value", "order_key")


@query("effective_start", f"""
    SELECT c_custkey AS state_key, coalesce(last_value, '1995-01-01') AS effective_start,
           last_value IS NOT NULL AS from_state
    FROM customer LEFT JOIN ({STATE_SQL}) ON state_key = c_custkey
""")
def effective_start(spark, d):
    specs = scan(spark, "customer", d).select(
        F.col("c_custkey").alias("state_key"), F.lit("1995-01-01").alias("start_value")
    )
    return S.effective_start(specs, _saved_cursors(spark, d))


@query("conform_schema", """
    SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, l_linenumber AS l_linenumber,
           CAST(l_quantity AS DECIMAL(12, 2)) AS l_quantity,
           CAST(l_extendedprice AS DECIMAL(12, 2)) AS l_extendedprice,
           CAST(l_shipdate AS DATE) AS l_shipdate, 'pending' AS status, CAST(NULL AS VARCHAR) AS notes
    FROM lineitem
""")
def conform_schema(spark, d):
    target = T.StructType([
        T.StructField("l_orderkey", T.IntegerType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DecimalType(12, 2)),
        T.StructField("l_extendedprice", T.DecimalType(12, 2)),
        T.StructField("l_shipdate", T.DateType()),
        T.StructField("status", T.VarcharType(30)),
        T.StructField("notes", T.StringType()),
    ])
    source = scan(spark, "lineitem", d).selectExpr(
        "l_orderkey AS L_ORDERKEY", "l_linenumber AS L_LineNumber", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    return S.conform(source, target, {"status": "pending"})


@query("next_batch", """
    SELECT event_id, ts, event_type FROM events
    WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND event_type <> 'error' ORDER BY ts LIMIT 1000
""")
def next_batch(spark, d):
    rows = S.next_batch(scan(spark, "events", d), "ts", "2024-01-10 00:00:00", predicate="event_type <> 'error'")
    return rows.select("event_id", "ts", "event_type")


@query("next_batch_ties", """
    WITH later AS (SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders
                   WHERE o_orderdate > TIMESTAMP '1996-01-02 00:00:00')
    SELECT o_orderkey, o_orderdate, o_orderstatus FROM (
        SELECT *, rank() OVER (ORDER BY o_orderdate) AS r FROM later) WHERE r <= 1000
""")
def next_batch_ties(spark, d):
    rows = S.next_batch_with_ties(scan(spark, "orders", d), "o_orderdate", "1996-01-02 00:00:00")
    return rows.select("o_orderkey", "o_orderdate", "o_orderstatus")


@query("next_batch_large", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM (
        SELECT *, rank() OVER (ORDER BY l_shipdate) AS r FROM lineitem
        WHERE l_shipdate > TIMESTAMP '1995-03-01 00:00:00') WHERE r <= 25000
""")
def next_batch_large(spark, d):
    rows = S.next_batch_with_ties(scan(spark, "lineitem", d), "l_shipdate", "1995-03-01 00:00:00", n=25_000)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@query("batch_cursor", """
    SELECT max(ts) AS last_value, count(*) AS n_rows FROM (
        SELECT ts FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' ORDER BY ts LIMIT 1000)
""")
def batch_cursor(spark, d):
    batch = S.next_batch(scan(spark, "events", d), "ts", "2024-01-05 00:00:00")
    return S.batch_cursor(batch, "ts")


@query("next_batch_exact_large", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM lineitem
    WHERE l_shipdate > TIMESTAMP '1995-01-01 00:00:00'
    ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity LIMIT 25000
""")
def next_batch_exact_large(spark, d):
    rows = S.project(scan(spark, "lineitem", d), ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate"])
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    return S.next_batch(rows, "l_shipdate", "1995-01-01 00:00:00", 25_000, tie_break=order)
