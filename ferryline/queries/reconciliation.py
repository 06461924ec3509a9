"""Audit verdicts, run summaries and the error trail, with one load per order.

An order stands for a load: its lines are the source rows, the lines shipped
early the target before, and the closed or late lines the target after.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryline.operators import reconcile as R
from ferryline.queries import query
from ferryline.queries.scalars import REDACT_SQL
from ferryline.session import new_folder
from ferryline.sources.audit_log import error_rows, read_trace, write_trace
from ferryline.sources.tables import scan

MODE_SQL = """
    CASE WHEN o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'INSERT' ELSE 'UPSERT' END
"""


def _typed(orders):
    """Orders with a migration type and a load strategy spelt as people spell them."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    kind = F.when(status == "F", F.lit(None)).when(status == "O", "incremental").otherwise(" Incremental\t")
    kind = F.when((status == "F") & (priority == "1-URGENT"), "full").otherwise(kind)
    strategy = (
        F.when(priority == "1-URGENT", " APPEND").when(priority == "2-HIGH", "append_only")
        .when(priority == "3-MEDIUM", "upsert").when(priority == "4-NOT SPECIFIED", " ")
    )
    return orders.select("*", R.write_mode(kind, strategy).alias("write_mode"))


@query("write_mode", f"SELECT o_orderkey, {MODE_SQL} AS write_mode FROM orders")
def write_mode(spark, d):
    return _typed(scan(spark, "orders", d)).select("o_orderkey", "write_mode")


COUNTS_SQL = f"""
    counts AS (
        SELECT o_orderkey, o_custkey, o_orderdate, {MODE_SQL} AS write_mode, source_selected, target_before,
               CASE WHEN o_totalprice < 450000 THEN target_after END AS target_after
        FROM orders LEFT JOIN (
            SELECT l_orderkey,
                   count(*) FILTER (l_returnflag <> 'R') AS source_selected,
                   count(*) FILTER (l_shipdate < TIMESTAMP '1997-01-01 00:00:00') AS target_before,
                   count(*) FILTER (l_linestatus = 'F' OR l_shipdate >= TIMESTAMP '1999-01-01 00:00:00') AS target_after
            FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
    deltas AS (SELECT *, target_after - target_before AS target_net_delta FROM counts),
    verdicts AS (
        SELECT *, CASE
            WHEN source_selected IS NULL AND target_net_delta IS NULL THEN 'UNAVAILABLE'
            WHEN source_selected IS NULL THEN 'TARGET_DELTA_ONLY'
            WHEN target_net_delta IS NULL THEN 'SOURCE_ONLY'
            WHEN source_selected = 0 THEN CASE WHEN target_net_delta = 0 THEN 'CONSISTENT' ELSE 'INCONSISTENT' END
            WHEN target_net_delta < 0 THEN 'INCONSISTENT'
            WHEN write_mode = 'INSERT' THEN CASE WHEN target_net_delta = source_selected THEN 'CONSISTENT' ELSE 'INCONSISTENT' END
            WHEN target_net_delta > source_selected THEN 'INCONSISTENT'
            ELSE 'CONSISTENT' END AS consistency FROM deltas),
    audited AS (
        SELECT *, CASE
            WHEN consistency IN ('INCONSISTENT', 'UNAVAILABLE') THEN 'UNAVAILABLE'
            WHEN consistency = 'TARGET_DELTA_ONLY' THEN 'TARGET_DELTA_ONLY'
            WHEN source_selected = 0 THEN 'NO_SOURCE_ROWS'
            WHEN consistency = 'SOURCE_ONLY' THEN 'SOURCE_COUNT_ONLY'
            WHEN write_mode = 'INSERT' THEN 'INSERT_APPLIED'
            WHEN target_net_delta = source_selected THEN 'UPSERT_INSERTS_ONLY'
            WHEN target_net_delta > 0 THEN 'UPSERT_INSERTS_AND_UPDATES'
            ELSE 'UPSERT_NO_NET_CHANGE' END AS outcome,
            CASE WHEN consistency = 'INCONSISTENT' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
            CASE WHEN consistency = 'INCONSISTENT' THEN 0
                 ELSE coalesce(source_selected, greatest(target_net_delta, 0), 0) END AS records_processed
        FROM verdicts)
"""


def _audited(spark, d):
    lines = scan(spark, "lineitem", d).groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") != "R").alias("source_selected"),
        F.count_if(F.col("l_shipdate") < "1997-01-01").alias("target_before"),
        F.count_if((F.col("l_linestatus") == "F") | (F.col("l_shipdate") >= "1999-01-01")).alias("target_after"),
    )
    orders = _typed(scan(spark, "orders", d)).join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    known = F.when(F.col("o_totalprice") < 450000, F.col("target_after"))
    return R.audit(orders.withColumn("target_after", known))


@query("audit_outcomes", f"""
    WITH {COUNTS_SQL} SELECT o_orderkey, write_mode, source_selected, target_net_delta, consistency, outcome FROM audited
""")
def audit_outcomes(spark, d):
    return _audited(spark, d).select(
        "o_orderkey", "write_mode", "source_selected", "target_net_delta", "consistency", "outcome"
    )


@query("audit_processed", f"WITH {COUNTS_SQL} SELECT o_orderkey, records_processed, status FROM audited")
def audit_processed(spark, d):
    return _audited(spark, d).select("o_orderkey", "records_processed", "status")


@query("final_status", """
    SELECT event_id, CASE event_type WHEN 'view' THEN 'SUCCESS' WHEN 'click' THEN 'BLOCKED' ELSE 'FAILED' END AS status
    FROM events
""")
def final_status(spark, d):
    given = (
        F.when(F.col("event_type") == "view", "SUCCESS").when(F.col("event_type") == "click", "BLOCKED")
        .when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "PENDING")
    )
    return scan(spark, "events", d).select("event_id", R.final_status(given).alias("status"))


@query("selected_count", "SELECT count(*) AS n_rows FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-30 00:00:00' AND o_orderstatus = 'O'")
def selected_count(spark, d):
    return R.selected_count(scan(spark, "orders", d).where("o_orderdate > '1996-06-30' AND o_orderstatus = 'O'"))


@query("target_counts", """
    SELECT b AS target_before, a AS target_after, a - b AS target_net_delta FROM (
        SELECT count(*) AS a, count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-01 00:00:00') AS b FROM lineitem)
""")
def target_counts(spark, d):
    lines = scan(spark, "lineitem", d)
    return R.target_counts(lines.where("l_shipdate < '1998-01-01'"), lines)


def _traces(spark, d):
    """One run per customer, one table per order; orders with a failed audit fail, very late ones are blocked."""
    late = F.col("o_orderdate") >= "2001-01-01"
    return _audited(spark, d).select(
        F.concat(F.lit("run-"), "o_custkey").alias("run_id"),
        F.col("o_orderkey").cast("int").alias("load_order"),
        F.concat(F.lit("public.t"), "o_orderkey").alias("table_id"),
        F.when(late, "BLOCKED").otherwise(F.col("status")).alias("status"),
        F.when(late, "parent failed").when(F.col("status") == "FAILED", F.concat(F.lit("audit password="), "o_orderkey")).alias("reason"),
        F.when(late, 0).otherwise(F.col("records_processed")).alias("records_processed"),
        F.hour("o_orderdate").cast("bigint").alias("duration_ms"),
        "write_mode", "source_selected", "target_before", "target_after", "target_net_delta", "consistency", "outcome",
    )


TRACES_SQL = f"""
    {COUNTS_SQL},
    traces AS (
        SELECT 'run-' || o_custkey AS run_id, CAST(o_orderkey AS INTEGER) AS load_order, 'public.t' || o_orderkey AS table_id,
               CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' THEN 'BLOCKED' ELSE status END AS status,
               CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' THEN 'parent failed'
                    WHEN status = 'FAILED' THEN 'audit password={{secret}}' END AS reason,
               CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' THEN 0 ELSE records_processed END AS records_processed,
               hour(o_orderdate) AS duration_ms, outcome
        FROM audited)
"""
RAW_TRACES_SQL = TRACES_SQL.replace("'audit password={secret}'", "'audit password=' || o_orderkey")
SAFE_TRACES_SQL = TRACES_SQL.replace("{secret}", "[REDACTED]")


@query("run_summary", f"""
    WITH {RAW_TRACES_SQL}
    SELECT run_id, count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS successful,
           count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'BLOCKED') AS blocked,
           CAST(sum(records_processed) AS BIGINT) AS records, CAST(sum(duration_ms) AS BIGINT) AS duration_ms
    FROM traces GROUP BY run_id
""")
def run_summary(spark, d):
    return R.run_summary(_traces(spark, d))


@query("run_failures", f"""
    WITH {RAW_TRACES_SQL}
    SELECT run_id, load_order, table_id, status, reason FROM traces WHERE status IN ('FAILED', 'BLOCKED')
""")
def run_failures(spark, d):
    return R.run_failures(_traces(spark, d))


@query("trace_rows", f"""
    WITH {SAFE_TRACES_SQL}
    SELECT table_id, run_id, load_order, status, reason, records_processed, outcome FROM traces
""")
def trace_rows(spark, d):
    rows = _traces(spark, d)
    none = F.lit(None)
    names = ["write_mode", "source_selected", "target_before", "target_after", "target_net_delta", "consistency", "outcome"]
    shaped = rows.select(
        # One run: a folder per run, and a run here is one whole pass over the orders.
        F.lit("run").alias("run_id"), F.col("run_id").alias("table_run_id"), "table_id", "load_order",
        none.cast("int").alias("level"), "status", "reason", "records_processed", "duration_ms",
        F.struct(*names, F.array_compact(F.array("reason")).alias("warnings")).alias("metrics"),
        F.array_compact(F.array("reason")).alias("errors"),
    )
    path = new_folder(spark, "traces")
    write_trace(shaped, path)
    return read_trace(spark, path).select(
        "table_id", F.col("table_run_id").alias("run_id"), "load_order", "status", "reason", "records_processed",
        F.col("metrics.outcome").alias("outcome"),
    )


MESSAGE_SQL = """'user ' || user_id || ' token=' || event_id || ' "jwt": "' || props || '" end'"""


@query("error_rows", f"""
    SELECT event_id AS table_run_id, 'ERROR' AS severity, 'FAILED' AS status,
           CASE WHEN event_type <> 'view' THEN 'public.' || event_type END AS table_id,
           CASE WHEN event_type = 'error' THEN 'RuntimeError' ELSE 'UnknownException' END AS error_type,
           CASE WHEN event_type = 'signup' THEN 'Fallo sin diagnostico disponible.'
                ELSE {REDACT_SQL.format(text=MESSAGE_SQL)} END AS message
    FROM events
""")
def error_rows_query(spark, d):
    events = scan(spark, "events", d)
    message = F.expr(MESSAGE_SQL)  # the JSON in props closes the quoted secret early
    failures = events.select(
        F.col("ts").alias("at"), F.lit("run").alias("run_id"), F.col("event_id").alias("table_run_id"),
        F.lit("TABLE_LOAD").alias("phase"), F.lit(None).cast("string").alias("table_schema"),
        F.when(F.col("event_type") != "view", F.upper("event_type")).alias("table_name"),
        F.when(F.col("event_type") == "error", "RuntimeError").alias("error_type"),
        F.when(F.col("event_type") != "signup", message).otherwise(" \n").alias("message"),
        F.lit(None).cast("string").alias("context"),
    )
    return error_rows(failures).select("table_run_id", "severity", "status", "table_id", "error_type", "message")
