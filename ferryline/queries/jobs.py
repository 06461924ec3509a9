"""Whole load jobs: their final target, or their trace."""

from __future__ import annotations

from dataclasses import replace
from functools import cache

from pyspark.sql import functions as F

from ferryline.operators.rows import ForeignKey, TargetSchema
from ferryline.plans.contract import Incremental, TableLoad, TableRef, columns
from ferryline.plans.loads import full_load, incremental_load, incremental_loads
from ferryline.plans.migrate import migrate
from ferryline.queries import query
from ferryline.session import new_folder
from ferryline.sources.tables import VersionedTable, scan
from ferryline.streaming.upsert import keep_digests, late_rows, late_rows_by_digest, stream_upsert

# --- the contract: every given table --------------------------------------------

@cache
def schemas() -> dict[str, TargetSchema]:
    def table(ddl: str, key: list[str], foreign_keys: dict[str, tuple[str, str]] | None = None, **rest) -> TargetSchema:
        fks = [ForeignKey(column, f"public.{parent}", pk) for column, (parent, pk) in (foreign_keys or {}).items()]
        return TargetSchema(columns(ddl), key, foreign_keys=fks, **rest)

    return {
        "region": table("r_regionkey int, r_name varchar(30) NOT NULL", ["r_regionkey"]),
        "nation": table("n_nationkey int, n_name varchar(30) NOT NULL, n_regionkey int", ["n_nationkey"],
                        {"n_regionkey": ("region", "r_regionkey")}),
        "customer": table(
            "c_custkey bigint, c_name varchar(100) NOT NULL, c_nationkey int, c_acctbal decimal(12,2),"
            "c_mktsegment varchar(30)", ["c_custkey"], {"c_nationkey": ("nation", "n_nationkey")}),
        "supplier": table("s_suppkey bigint, s_name varchar(100), s_nationkey int, s_acctbal decimal(12,2)",
                          ["s_suppkey"], {"s_nationkey": ("nation", "n_nationkey")}),
        "part": table(
            "p_partkey bigint, p_name varchar(200), p_brand varchar(20), p_type string, p_size int,"
            "p_retailprice decimal(10,2), stock int NOT NULL", ["p_partkey"], defaults={"stock": 0}),
        "orders": table(
            "o_orderkey bigint, o_custkey bigint, o_orderstatus varchar(30) NOT NULL, o_totalprice double,"
            "o_orderdate timestamp_ntz NOT NULL, o_orderpriority string", ["o_orderkey"],
            {"o_custkey": ("customer", "c_custkey")}),
        "lineitem": table(
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
            "l_extendedprice double, l_discount double, l_tax double, l_returnflag varchar(1),"
            "l_linestatus varchar(1), l_shipdate timestamp_ntz", ["l_orderkey", "l_linenumber"],
            {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"),
             "l_suppkey": ("supplier", "s_suppkey")}),
        "events": table(
            "event_id bigint, ts timestamp_ntz NOT NULL, user_id bigint, event_type varchar(20), value double,"
            "props string", ["event_id"]),
        # Too narrow for the texts: this load is rejected and its dependents are blocked.
        "documents": table("doc_id bigint, text varchar(50), lang varchar(2), source string, n_chars bigint", ["doc_id"]),
        "labels": table("doc_id bigint, quality int, toxic int", ["doc_id"], {"doc_id": ("documents", "doc_id")}),
        # Two tables that need each other first, and one below them.
        "pages": table("page_id bigint, url string, html string", ["page_id"], {"page_id": ("benchmark", "item_id")}),
        "benchmark": table("item_id bigint, text string", ["item_id"], {"item_id": ("pages", "page_id")}),
        "embeddings": table("vec_id bigint, embedding array<float>, label int", ["vec_id"],
                            {"vec_id": ("benchmark", "item_id")}),
        "conversations": table("conv_id bigint, turn bigint, role varchar(20), text string", ["conv_id", "turn"]),
    }


FIRST_EVENT = "2024-01-01 00:00:00"
DAY = 86_400_000_000  # microseconds
EVENT_BATCH = Incremental("ts", FIRST_EVENT, 5000, "append")


def load_of(name: str, **settings) -> TableLoad:
    return TableLoad(name, TableRef(name), TableRef(name, "public"), schemas()[name], enabled=True, **settings)


def target_of(spark, name: str, root: str) -> VersionedTable:
    schema = schemas()[name]
    return VersionedTable(spark, f"{root}/{name}", schema.stored, schema.primary_key)


def _contract() -> list[TableLoad]:
    special = {
        "lineitem": {"order_by": ["l_shipdate"]},
        "events": {"migration_type": "incremental", "incremental": EVENT_BATCH},
        "conversations": {"where": "role <> 'system'"},
    }
    return [load_of(name, **special.get(name, {})) for name in schemas()]


@query("migrate_trace", f"""
    WITH counts AS (
        SELECT 'region' AS t, 0 AS level, count(*) AS n, count(*) AS k FROM region
        UNION ALL SELECT 'nation', 1, count(*), count(*) FROM nation
        UNION ALL SELECT 'customer', 2, count(*), count(*) FROM customer
        UNION ALL SELECT 'supplier', 2, count(*), count(*) FROM supplier
        UNION ALL SELECT 'part', 0, count(*), count(*) FROM part
        UNION ALL SELECT 'orders', 3, count(*), count(*) FROM orders
        UNION ALL SELECT 'lineitem', 4, count(*), count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
        UNION ALL SELECT 'events', 0, least(5000, count(*)), least(5000, count(*)) FROM events
                                      WHERE ts > TIMESTAMP '{FIRST_EVENT}'
        UNION ALL SELECT 'conversations', 0, count(*), count(*) FROM conversations WHERE role <> 'system')
    SELECT 'public.' || t AS table_id, level, 'SUCCESS' AS status, n AS records_processed, n AS source_selected,
           k AS target_net_delta, 'CONSISTENT' AS consistency,
           CASE WHEN t = 'events' THEN 'INSERT_APPLIED' WHEN n = k THEN 'UPSERT_INSERTS_ONLY'
                ELSE 'UPSERT_INSERTS_AND_UPDATES' END AS outcome
    FROM counts
    UNION ALL SELECT 'public.documents', 0, 'FAILED', 0, count(*), NULL, 'FAILED', 'EXECUTION_FAILED' FROM documents
    UNION ALL SELECT 'public.labels', 1, 'BLOCKED', 0, NULL, NULL, 'BLOCKED', 'BLOCKED'
    UNION ALL SELECT 'public.pages', NULL, 'FAILED', 0, NULL, NULL, 'FAILED', 'FAILED'
    UNION ALL SELECT 'public.benchmark', NULL, 'FAILED', 0, NULL, NULL, 'FAILED', 'FAILED'
    UNION ALL SELECT 'public.embeddings', NULL, 'BLOCKED', 0, NULL, NULL, 'BLOCKED', 'BLOCKED'
""")
def migrate_trace(spark, d):
    root = new_folder(spark, "migration")
    loads = _contract()
    trace = migrate(
        spark, loads, {load.key: scan(spark, load.key, d) for load in loads},
        {load.key: target_of(spark, load.key, f"{root}/tables") for load in loads}, "run-1", root, strict=False,
    )
    return trace.select(
        "table_id", "level", "status", "records_processed", "metrics.source_selected", "metrics.target_net_delta",
        "metrics.consistency", "metrics.outcome",
    )


# --- single loads -------------------------------------------------------------


@query("full_load", """
    SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN 'OLD' ELSE o_orderpriority END AS o_orderpriority)
    FROM orders WHERE o_orderstatus <> 'P' OR o_orderdate < TIMESTAMP '1998-01-01 00:00:00'
""")
def full_load_orders(spark, d):
    orders = scan(spark, "orders", d)
    target = target_of(spark, "orders", new_folder(spark, "full"))
    old = orders.where("o_orderdate < '1998-01-01'").withColumn("o_orderpriority", F.lit("OLD"))
    target.publish(target.stage_upsert(old), "earlier")
    load = load_of("orders", where="o_orderstatus <> 'P'")
    full_load(load, orders, target, "run-1", {"public.customer": scan(spark, "customer", d)})
    return target.read()


@query("incremental_upsert", """
    WITH batch AS (SELECT * EXCLUDE (r) FROM (
            SELECT *, rank() OVER (ORDER BY o_orderdate) AS r FROM orders
            WHERE o_orderdate > TIMESTAMP '1995-06-30 00:00:00' AND o_totalprice > 1000) WHERE r <= 5000)
    SELECT * FROM batch
    UNION ALL SELECT * REPLACE ('OLD' AS o_orderpriority) FROM orders
        WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00' AND o_orderkey NOT IN (SELECT o_orderkey FROM batch)
""")
def incremental_upsert(spark, d):
    orders = scan(spark, "orders", d)
    root = new_folder(spark, "incremental")
    target = target_of(spark, "orders", root)
    old = orders.where("o_orderdate < '1996-01-01'").withColumn("o_orderpriority", F.lit("OLD"))
    target.publish(target.stage_upsert(old), "earlier")
    spec = Incremental("o_orderdate", "1995-06-30 00:00:00", 5000, "upsert", ["o_orderkey"])
    load = load_of("orders", migration_type="incremental", incremental=spec, where="o_totalprice > 1000")
    incremental_load(load, orders, target, "run-1", f"{root}/state")
    return target.read()


@query("incremental_append", f"""
    SELECT * FROM events WHERE ts <= TIMESTAMP '{FIRST_EVENT}'
    UNION ALL SELECT * EXCLUDE (r) FROM (
        SELECT *, rank() OVER (ORDER BY ts) AS r FROM events WHERE ts > TIMESTAMP '{FIRST_EVENT}') WHERE r <= 10000
""")
def incremental_append(spark, d):
    """Two batches of 5000, the second from the cursor the first one saved."""
    events = scan(spark, "events", d)
    root = new_folder(spark, "appends")
    target = target_of(spark, "events", root)
    target.publish(target.stage_append(events.where(f"ts <= '{FIRST_EVENT}'")), "earlier")
    load = load_of("events", migration_type="incremental", incremental=EVENT_BATCH)
    for run_id in ("run-1", "run-2"):
        incremental_load(load, events, target, run_id, f"{root}/state")
    return target.read()


@query("incremental_drain", "SELECT * FROM events")
def incremental_drain(spark, d):
    """All of `events` in batches; the run stops after its second batch and is started again under its id."""
    events = scan(spark, "events", d)
    root = new_folder(spark, "drain")
    target = target_of(spark, "events", root)
    load = load_of("events", migration_type="incremental", incremental=Incremental("ts", "1970-01-01 00:00:00", 4000, "append"))
    for done in ("run.1", "run.2"):
        incremental_load(load, events, target, done, f"{root}/state")
    incremental_loads(load, events, target, "run", f"{root}/state")
    return target.read()


@query("migrate_shared_target", "SELECT * FROM orders WHERE o_orderstatus <> 'P'")
def migrate_shared_target(spark, d):
    """Two filtered entries of one contract load one target; the run is started twice under its id."""
    root = new_folder(spark, "shared")
    loads = [replace(load_of("orders", where=f"o_orderstatus = '{status}'"), key=f"orders_{status}") for status in "FO"]
    targets = {load.key: target_of(spark, "orders", root) for load in loads}
    for _ in range(2):
        migrate(spark, loads, {load.key: scan(spark, "orders", d) for load in loads}, targets, "run-1", root)
    return targets["orders_F"].read()


@query("migrate_schema_check", """
    SELECT 'public.region' AS table_id, 'FAILED' AS status, 0 AS records_processed,
           'not run: the schemas differ: nullability r_name, too_short r_name' AS reason
    UNION ALL SELECT 'public.nation', 'BLOCKED', 0, 'not run: parents failed: region'
    UNION ALL SELECT 'public.part', 'SUCCESS', count(*), NULL FROM part
""")
def migrate_schema_check(spark, d):
    """A source declared wider than its target is not loaded, nor what depends on it."""
    root = new_folder(spark, "schema-check")
    loads = [load_of(name) for name in ("region", "nation", "part")]
    wider = TargetSchema(columns("r_regionkey int, r_name varchar(40)"), ["r_regionkey"])
    trace = migrate(
        spark, loads, {load.key: scan(spark, load.key, d) for load in loads},
        {load.key: target_of(spark, load.key, f"{root}/tables") for load in loads}, "run-1", root, strict=False,
        source_schemas={"region": wider, "nation": schemas()["nation"]})
    return trace.select("table_id", "status", "records_processed", "reason")


# --- streaming ----------------------------------------------------------------


@query("stream_upsert", """
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1
""")
def stream_upsert_events(spark, d):
    root = new_folder(spark, "stream")
    schema = scan(spark, "events", d).schema
    target = VersionedTable(spark, f"{root}/target", schema, ["user_id"])
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream_upsert(stream, target, ["user_id"], f"{root}/checkpoint", ["ts"], name=root.rsplit("/", 1)[1])
    return target.read()


@query("late_rows", """
    SELECT event_id, ts FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' AND event_type = 'error'
""")
def late_events(spark, d):
    events = scan(spark, "events", d)
    target = events.where("event_type <> 'error'")
    return late_rows(events, target, "ts", "2024-01-20 00:00:00", ["event_id"]).select("event_id", "ts")


@query("late_rows_by_digest", """
    SELECT event_id, ts FROM events
    WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' AND (event_type = 'error' AND hour(ts) = 7 OR event_type = 'signup' AND hour(ts) = 23)
""")
def late_events_by_digest(spark, d):
    """The target was complete once, as far as its digests say, up to the tenth; ranges are days, hours and minutes."""
    events = scan(spark, "events", d)
    hour = F.hour("ts")
    late = ((F.col("event_type") == "error") & (hour == 7)) | ((F.col("event_type") == "signup") & (hour == 23))
    target = events.where(~F.coalesce(late, F.lit(False)))
    folder = new_folder(spark, "digests")
    keep_digests(target, "ts", "2024-01-10 00:00:00", ["event_id"], DAY, folder)
    found = late_rows_by_digest(events, target, "ts", "2024-01-20 00:00:00", ["event_id"], [DAY, DAY / 24, DAY / 1440],
                                spark.read.parquet(folder))
    return found.select("event_id", "ts")
