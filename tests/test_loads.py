import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from ferryline.operators.rows import ForeignKey, TargetSchema
from ferryline.plans import contract as C
from ferryline.plans.loads import LoadFailed, full_load, incremental_load, incremental_loads
from ferryline.plans.migrate import MigrationFailed, Plan, migrate, run_by_edges
from ferryline.sources.jdbc import Connection
from ferryline.sources.state import read_state, saved_cursor
from ferryline.sources.tables import VersionedTable
from ferryline.streaming.upsert import late_rows, stream_upsert


def schema(ddl="id int NOT NULL, name varchar(9), updated_at timestamp_ntz", key=("id",), **rest):
    return TargetSchema(C.columns(ddl), list(key), **rest)


def load(name="customers", **settings):
    settings.setdefault("schema", schema())
    settings.setdefault("enabled", True)
    return C.TableLoad(name, C.TableRef(name), C.TableRef(name, "public"), **settings)


def incremental(strategy="upsert", size=100, keys=("id",), start="2026-01-01T00:00:00"):
    return C.Incremental("updated_at", start, size, strategy, list(keys) if keys else None)


@pytest.fixture
def source(spark):
    day = dt.datetime(2026, 1, 2)
    return spark.createDataFrame([(i, f"n{i}", day + dt.timedelta(days=i // 4)) for i in range(20)],
                                 "id int, name string, updated_at timestamp_ntz")


@pytest.fixture
def target(spark, folder):
    return VersionedTable(spark, f"{folder}/target", schema().stored, ["id"])


def test_full_load_and_rerun(source, target):
    first = full_load(load(), source, target, "r1")
    assert (first.records_processed, first.target_before, first.target_after) == (20, 0, 20)
    assert first.outcome == "UPSERT_INSERTS_ONLY"
    again = full_load(load(), source, target, "r2")
    assert (again.records_processed, again.outcome, target.count()) == (20, "UPSERT_NO_NET_CHANGE", 20)


def test_full_load_keeps_target_only_rows(source, target):
    full_load(load(), source.where("id < 8"), target, "r1")
    result = full_load(load(where="id >= 4"), source, target, "r2")
    assert result.outcome == "UPSERT_INSERTS_AND_UPDATES" and target.count() == 20


def test_same_run_is_not_loaded_twice(source, target):
    full_load(load(), source, target, "r1")
    assert full_load(load(), source, target, "r1").warnings
    assert target.commit_of("r1")["version"] == 1


def test_upsert_needs_a_key(source, target):
    with pytest.raises(ValueError):
        full_load(load(schema=schema(key=())), source, target, "r1")


def test_rejects_fail_the_load_and_publish_nothing(spark, source, target, folder):
    bad = source.withColumn("name", F.when(F.col("id") == 3, "far too long").otherwise(F.col("name")))
    with pytest.raises(LoadFailed, match="1 rows break"):
        full_load(load(), bad, target, "r1", rejects_path=f"{folder}/rejects")
    assert target.count() == 0
    rejected = spark.read.json(f"{folder}/rejects").collect()
    assert [(r.id, r._violations[0].rule) for r in rejected] == [(3, "too_long")]


def test_orphans_fail_the_load(spark, source, target, folder):
    fk = [ForeignKey("id", "public.parents", "pid")]
    parents = {"public.parents": spark.range(18).withColumnRenamed("id", "pid")}
    with pytest.raises(LoadFailed, match="2 rows without a parent"):
        full_load(load(schema=schema(foreign_keys=fk)), source, target, "r1", parents, f"{folder}/rejects")
    assert spark.read.json(f"{folder}/rejects").count() == 2


def test_self_reference_is_checked_on_the_merged_rows(spark, folder):
    staff = schema("id int, manager_id int", foreign_keys=[ForeignKey("manager_id", "public.staff", "id")])
    table = VersionedTable(spark, folder, staff.stored, ["id"])
    first = spark.createDataFrame([(1, None), (2, 1)], "id int, manager_id int")
    full_load(load("staff", schema=staff), first, table, "r1")
    full_load(load("staff", schema=staff), spark.createDataFrame([(3, 2)], "id int, manager_id int"), table, "r2")
    with pytest.raises(LoadFailed, match="without a parent"):
        full_load(load("staff", schema=staff), spark.createDataFrame([(4, 9)], "id int, manager_id int"), table, "r3")
    assert table.count() == 3


def test_unique_is_checked_on_the_merged_rows(source, target):
    rules = schema(unique=["name"])
    full_load(load(schema=rules), source, target, "r1")
    clash = source.limit(1).withColumn("id", F.lit(99))
    with pytest.raises(LoadFailed, match="unique"):
        full_load(load(schema=rules), clash, target, "r2")


@pytest.mark.parametrize("strategy", ["upsert", "append", "append_only"])
def test_batches_until_none_is_left(spark, source, target, folder, strategy):
    spec = load(migration_type="incremental", incremental=incremental(strategy, 6))
    results = incremental_loads(spec, source, target, "r", f"{folder}/state")
    assert [r.source_selected for r in results] == [8, 8, 4, 0]  # ties stay together
    assert target.count() == 20
    assert results[-1].outcome == "NO_SOURCE_ROWS" and not results[-1].state_updated
    assert saved_cursor(spark, f"{folder}/state", "public.customers") == "2026-01-06 00:00:00"
    last = read_state(spark, f"{folder}/state").first()
    assert (last.previous_value, last.records_processed) == ("2026-01-04 00:00:00", 4) or last.previous_value


def test_batch_cut_through_ties_loses_rows(source, target, folder):
    spec = load(migration_type="incremental", incremental=incremental(size=6))
    state = f"{folder}/state"
    first = incremental_load(spec, source, target, "r1", state, with_ties=False)
    second = incremental_load(spec, source, target, "r2", state, with_ties=False)
    assert (first.source_selected, second.source_selected) == (6, 6)
    assert target.read().where("updated_at <= '2026-01-03'").count() == 6  # two of eight are gone for good


def test_lost_state_is_written_again_by_the_same_run(spark, source, target, folder):
    spec = load(migration_type="incremental", incremental=incremental("append", 6))
    incremental_load(spec, source, target, "r1", f"{folder}/state")
    result = incremental_load(spec, source, target, "r1", f"{folder}/lost-state")
    assert target.count() == 8 and result.warnings
    assert saved_cursor(spark, f"{folder}/lost-state", "public.customers") == "2026-01-03 00:00:00"


def test_append_of_taken_keys_fails(source, target, folder):
    spec = load(migration_type="incremental", incremental=incremental("append"))
    full_load(load(), source.where("id = 5"), target, "r0")
    with pytest.raises(LoadFailed, match="already has"):
        incremental_load(spec, source, target, "r1", f"{folder}/state")


def test_an_append_opens_only_the_buckets_it_meets(spark, folder):
    rows = spark.range(4_000).selectExpr("id", "concat('v', id) AS v")
    table = VersionedTable(spark, folder, rows.schema, ["id"], buckets=16)
    table.publish(table.stage_append(rows), "r1")
    batch = spark.createDataFrame([(17, "x"), (9_000, "y")], "id int, v string")
    near = table.read_near(batch)
    opened = {r[0].rsplit("/", 2)[-2] for r in near.select(F.input_file_name()).distinct().collect()}
    assert 1 <= len(opened) <= 2 and near.where("id = 17").count() == 1
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,17), LessThanOrEqual(id,9000)" in plan
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line).split("PartitionFilters")[1]
    assert "load_bucket" in filters.split("PushedFilters")[0]  # the other folders are pruned, not read and dropped
    assert table.read_near(batch.limit(0)).count() == 0
    assert VersionedTable(spark, f"{folder}-none", rows.schema, ["id"]).read_near(batch).count() == 0


# --- whole runs ----------------------------------------------------------------


def run(spark, folder, loads, sources, **options):
    targets = {x.key: VersionedTable(spark, f"{folder}/t/{x.key}", x.schema.stored, x.schema.primary_key) for x in loads}
    trace = migrate(spark, loads, sources, targets, "run-1", folder, **options)
    return {r.table_id.split(".")[1]: r for r in trace.collect()}


def child_of(parent, **rest):
    return schema("id int, up int", foreign_keys=[ForeignKey("up", f"public.{parent}", "id")], **rest)


def test_failed_parent_blocks_its_children(spark, source, folder):
    bad = source.withColumn("name", F.lit("password=far-too-long"))
    children = spark.createDataFrame([(1, 1)], "id int, up int")
    loads = [load("orders", schema=child_of("customers")), load("items", schema=child_of("orders")),
             load("customers"), load("other"), load("off", enabled=False)]
    sources = {"customers": bad, "orders": children, "items": children, "other": source}
    found = run(spark, folder, loads, sources, strict=False)
    assert {k: v.status for k, v in found.items()} == {
        "customers": "FAILED", "orders": "BLOCKED", "items": "BLOCKED", "other": "SUCCESS"}
    assert found["customers"].metrics.outcome == "EXECUTION_FAILED" and found["customers"].errors
    assert found["orders"].metrics.warnings == ["not run: parents failed: customers"]
    assert [found[k].load_order for k in ("customers", "other", "orders", "items")] == [1, 2, 3, 4]
    errors = spark.read.json(f"{folder}/errors").collect()
    assert [(e.table_id, e.error_type, e.severity) for e in errors] == [("public.customers", "LoadFailed", "ERROR")]


def test_strict_run_raises_after_writing_its_trace(spark, source, folder):
    with pytest.raises(MigrationFailed, match="1 failed and 0 blocked") as error:
        run(spark, folder, [load()], {"customers": source.withColumn("name", F.lit("far too long"))})
    assert error.value.trace.first().status == "FAILED"


def test_cycles_do_not_fail_a_strict_run(spark, source, folder):
    children = spark.createDataFrame([(1, 1)], "id int, up int")
    loads = [load("projects"), load("tasks", schema=child_of("task_links")), load("task_links", schema=child_of("tasks")),
             load("task_assignments", schema=child_of("tasks"))]
    sources = {"projects": source, "tasks": children, "task_links": children, "task_assignments": children}
    found = run(spark, folder, loads, sources)
    assert {k: v.status for k, v in found.items()} == {
        "projects": "SUCCESS", "tasks": "FAILED", "task_links": "FAILED", "task_assignments": "BLOCKED"}
    assert found["tasks"].records_processed == 0 and found["tasks"].start_time is None
    assert found["tasks"].duration_ms == 0 and found["task_assignments"].metrics.outcome == "BLOCKED"


# --- contract ------------------------------------------------------------------


@pytest.mark.parametrize("changes, message", [
    ({"name": "customers;drop_table"}, "identifier"),
    ({"migration_type": "copy"}, "migration type"),
    ({"migration_type": " "}, "migration type"),
    ({"migration_type": "incremental"}, "settings"),
    ({"migration_type": "incremental", "incremental": C.Incremental()}, "cursor column"),
    ({"migration_type": "incremental", "incremental": C.Incremental("a b", "1")}, "identifier"),
    ({"migration_type": "incremental", "incremental": C.Incremental("a")}, "start value"),
    ({"migration_type": "incremental", "incremental": C.Incremental("a", "1", 0)}, "batch size"),
    ({"migration_type": "incremental", "incremental": C.Incremental("a", "1", 1, "replace")}, "strategy"),
    ({"migration_type": "incremental", "incremental": C.Incremental("a", "1", 1, None, [])}, "empty"),
    ({"migration_type": "incremental", "incremental": C.Incremental("a", "1", 1, None, ["x-y"])}, "identifier"),
    ({"enabled": False}, "enabled"),
])
def test_contract_rules(spark, changes, message):
    with pytest.raises(C.InvalidContract, match=message):
        C.validate([load(**changes)])


def test_table_is_off_unless_enabled(spark):
    off = C.TableLoad("x", C.TableRef("bad name"), C.TableRef("x"), schema())
    assert C.validate([off, load()]) == [load()]
    assert C.TableRef(" Orders ").id == "public.orders"


# --- streaming and databases ---------------------------------------------------


def test_stream_upsert_over_several_files(spark, source, folder):
    updates = source.withColumn("name", F.lit("new")).where("id >= 10").withColumn(
        "updated_at", F.expr("updated_at + interval 1 year"))
    source.coalesce(1).write.parquet(f"{folder}/in/a")
    updates.coalesce(1).write.parquet(f"{folder}/in/b")
    target = VersionedTable(spark, f"{folder}/out", source.schema, ["id"])

    def go():
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
        stream_upsert(stream, target, ["id"], f"{folder}/checkpoint", ["updated_at"], name="s")

    go()
    assert target.count() == 20 and target.read().where("name = 'new'").count() == 10
    version = target.view().version
    go()  # nothing new has arrived
    assert target.view().version == version == 2


def test_late_rows(spark, source, rows):
    target = source.where("id <> 3")
    assert [r[0] for r in rows(late_rows(source, target, "updated_at", "2026-01-04", ["id"]))] == [3]


def test_connection():
    assert Connection("jdbc:postgresql://h/db", "u", "p").options == {
        "url": "jdbc:postgresql://h/db", "driver": "org.postgresql.Driver", "user": "u", "password": "p"}
    assert "user" not in Connection("jdbc:x:y", driver="d").options
    assert Connection("jdbc:mysql://h/db").merge == Connection("jdbc:mariadb://h").merge == "on duplicate key"
    assert Connection("jdbc:sqlserver://h").merge == "merge;"
    assert Connection("jdbc:oracle:thin:@h").protocol == "oracle" and Connection("jdbc:oracle:thin:@h").merge == "merge"
    assert Connection("jdbc:postgresql://h").merge == "on conflict"
    assert Connection("jdbc:x:y", database_type=" MySQL ").merge == "on duplicate key"


# --- runs started again, shared targets, growing tables -------------------------


def test_a_drain_started_again_goes_on(spark, source, target, folder):
    spec = load(migration_type="incremental", incremental=incremental("append", 6))
    incremental_load(spec, source, target, "r.1", f"{folder}/state")
    incremental_load(spec, source, target, "r.2", f"{folder}/state")
    results = incremental_loads(spec, source, target, "r", f"{folder}/state")
    assert [r.published_before for r in results] == [True, True, False, False]
    assert target.count() == 20 and target.read().distinct().count() == 20


def test_many_batches_are_appended_together(spark, folder, rows, monkeypatch):
    """Many batches, a few passes: the same versions, commits and states as one by one."""
    from ferryline.plans import loads

    day, alone = dt.datetime(2026, 1, 2), []
    source = spark.createDataFrame([(i, f"n{i}", day + dt.timedelta(days=i // 3)) for i in range(48)], "id int, name string, updated_at timestamp_ntz")
    spec = load(migration_type="incremental", incremental=incremental("append", 4), where="id <> 7")
    found = {}
    one = loads.incremental_load
    monkeypatch.setattr(loads, "incremental_load", lambda *a, **k: alone.append(a[3]) or one(*a, **k))
    for wave in (1, 5):
        monkeypatch.setattr(loads, "WAVE", wave)
        table = VersionedTable(spark, f"{folder}/{wave}", schema().stored, ["id"])
        results = incremental_loads(spec, source, table, "r", f"{folder}/state{wave}")
        commits = [c[:5] for c in rows(table._log().select("version", "run_id", "cursor", "selected", "n_rows"))]
        states = rows(spark.read.json(f"{folder}/state{wave}").select("run_id", "previous_value", "last_value", "records_processed"))
        found[wave] = [(r.source_selected, r.target_before, r.target_after, r.previous_value, r.last_value, r.outcome, r.state_updated)
                       for r in results], commits, states, rows(table.read())
        assert saved_cursor(spark, f"{folder}/state{wave}", "public.customers") == results[-2].last_value == "2026-01-17 00:00:00"
    assert found[1] == found[5] and found[1][3] == rows(source.where("id <> 7"))
    assert [r[0] for r in found[1][0]] == [6, 5] + [6] * 6 + [0] and alone == ["r.9"] * 2  # the empty one that ends the drain


@pytest.mark.parametrize("fault", ["rule", "twice", "taken"])
def test_batches_before_a_broken_one_are_published(spark, source, folder, fault):
    table = VersionedTable(spark, f"{folder}/t", schema().stored, ["id"])
    if fault == "taken":
        table.publish(table.stage_append(source.where("id = 17")), "r0")
    bad = source.withColumn("name", F.when(F.col("id") == 17, "far too long" if fault == "rule" else "n").otherwise(F.col("name")))
    bad = bad.withColumn("id", F.when((F.col("id") == 17) & F.lit(fault == "twice"), 0).otherwise(F.col("id")))
    spec = load(migration_type="incremental", incremental=incremental("append", 4))
    with pytest.raises(LoadFailed, match={"rule": "1 rows break", "twice": "already has", "taken": "already has"}[fault]):
        incremental_loads(spec, bad, table, "r", f"{folder}/state")
    assert table.count() == 16 + (fault == "taken") and table.commit_of("r.4") and not table.commit_of("r.5")
    assert saved_cursor(spark, f"{folder}/state", "public.customers") == "2026-01-05 00:00:00"


def test_a_cursor_never_moves_back(spark, source, target, folder):
    spec, state = load(migration_type="incremental", incremental=incremental("append", 6)), f"{folder}/state"
    for run_id in ("r1", "r2", "r1"):
        incremental_load(spec, source, target, run_id, state)
    assert saved_cursor(spark, state, "public.customers") == "2026-01-05 00:00:00"


def test_two_entries_share_a_target(spark, source, folder):
    both = [load(f"part{i}", where=f"id % 2 = {i}") for i in (0, 1)]
    both = [C.TableLoad(**{**x.__dict__, "target": C.TableRef("all", "public")}) for x in both]
    targets = {x.key: VersionedTable(spark, f"{folder}/all", x.schema.stored, ["id"]) for x in both}
    for _ in range(2):  # the second start finds both published
        trace = migrate(spark, both, {x.key: source for x in both}, targets, "run's", folder)
        assert trace.count() == 2 and {r.status for r in trace.collect()} == {"SUCCESS"}
        assert targets["part0"].count() == 20 and targets["part0"].read().distinct().count() == 20


def test_entries_that_differ_only_in_case_are_refused():
    with pytest.raises(C.InvalidContract, match="repeat: a"):
        C.validate([load("A"), load(" a ")])


def test_an_unreadable_parent_fails_its_child_alone(spark, source, folder):
    class Broken(VersionedTable):
        def read(self):
            raise OSError("unreadable")

    loads = [load("customers"), load("orders", schema=child_of("customers")), load("other")]
    targets = {x.key: VersionedTable(spark, f"{folder}/t/{x.key}", x.schema.stored, x.schema.primary_key) for x in loads}
    targets["customers"].__class__ = Broken
    rows = spark.createDataFrame([(1, 1)], "id int, up int")
    trace = migrate(spark, loads, {"customers": source, "orders": rows, "other": source}, targets, "r", folder, strict=False)
    assert {r.table_id: r.status for r in trace.collect()} == {
        "public.customers": "SUCCESS", "public.orders": "FAILED", "public.other": "SUCCESS"}


def test_schemas_are_compared_before_loading(spark, source, folder):
    loads = [load("customers"), load("orders", schema=child_of("customers")), load("other")]
    declared = {"customers": schema("id int NOT NULL, name varchar(30), updated_at timestamp_ntz"), "other": schema()}
    rows = spark.createDataFrame([(1, 1)], "id int, up int")
    found = run(spark, folder, loads, {"customers": source, "orders": rows, "other": source}, strict=False, source_schemas=declared)
    assert {k: v.status for k, v in found.items()} == {"customers": "FAILED", "orders": "BLOCKED", "other": "SUCCESS"}
    assert "too_short name" in found["customers"].reason


def test_instants_survive_a_change_of_clocks(spark, folder):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.range(240).selectExpr("cast(id as int) id", "'n' name", "timestamp_seconds(1793509200 + id * 60) updated_at")
        rules = schema("id int NOT NULL, name varchar(9), updated_at timestamp")
        table = VersionedTable(spark, f"{folder}/clock", rules.stored, ["id"])
        spec = load(schema=rules, migration_type="incremental", incremental=incremental("append", 50, start="2026-10-01 00:00:00Z"))
        incremental_loads(spec, rows, table, "r", f"{folder}/state")
        assert table.count() == 240
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_table_outgrows_its_first_load(spark, folder, monkeypatch):
    from ferryline.sources import tables

    monkeypatch.setattr(tables, "BUCKET_ROWS", 10_000)
    table = VersionedTable(spark, f"{folder}/grows", spark.range(1).schema, ["id"])
    table.publish(table.stage_upsert(spark.range(100)), "r0")
    first = table.view().buckets
    table.publish(table.stage_upsert(spark.range(0, 50_000)), "r1")
    table.publish(table.stage_upsert(spark.range(49_000, 60_000).selectExpr("cast(id as int) id"), small_batch=True), "r2")
    assert table.view().buckets > first
    assert table.count() == table.read().distinct().count() == 60_000


def test_int_keys_meet_bigint_keys(spark, folder):
    table = VersionedTable(spark, f"{folder}/types", spark.range(1).schema, ["id"], buckets=16)
    table.publish(table.stage_upsert(spark.range(100)), "r0")
    table.publish(table.stage_upsert(spark.range(3).selectExpr("cast(id as int) id"), small_batch=True), "r1")
    assert table.count() == table.read().distinct().count() == 100


def test_appends_keep_commits_and_files_few(spark, folder):
    import pathlib

    root = pathlib.Path(folder.removeprefix("file:"))
    table = VersionedTable(spark, folder, spark.range(1).schema, ["id"], buckets=4)
    for i in range(6):
        table.publish(table.stage_append(spark.range(i * 100, i * 100 + 100, 1, 8)), f"r{i}")
    sizes = [p.stat().st_size for p in (root / "commits").glob("part*")]
    assert max(sizes) - min(sizes) < 40 and len(list((root / "data").rglob("*.parquet"))) <= 24
    assert table.count() == table.read().count() == 600
    table.publish(table.stage_upsert(spark.range(600)), "all")
    assert table.vacuum(1) == 24 and table.read().count() == 600
    with pytest.raises(ValueError, match="one bucket"):
        VersionedTable(spark, folder, spark.range(1).schema, buckets=2)


def test_replaced_buckets_are_pruned_and_vacuumed(spark, folder):
    """Full load, append, small upserts: each version reads what was in force, vacuum deletes what no kept one needs."""
    rows = spark.range(800).selectExpr("id", "'old' AS v")
    table = VersionedTable(spark, folder, rows.schema, ["id"], buckets=8)
    table.publish(table.stage_upsert(rows), "r1")
    table.publish(table.stage_append(spark.range(800, 900).selectExpr("id", "'more' AS v")), "r2")
    for i, number in enumerate((5, 850, 5)):
        batch = spark.createDataFrame([(number, f"new{i}")], "id bigint, v string")
        staged = table.stage_upsert(batch, small_batch=True)
        assert (staged.rows_before, staged.rows_after) == (900, 900) and len(staged.replaced) == 1
        assert table.read().where(f"v = 'new{i}'").count() == 0  # staged rows are not visible yet
        table.publish(staged, f"r{i + 3}")
    assert table.view(2).since == {} and len(table.view().since) == 2
    assert sorted((r.id, r.v) for r in table.read().where("v LIKE 'new%'").collect()) == [(5, "new2"), (850, "new1")]
    assert table.read().count() == table.count() == table.read().distinct().count() == 900
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters: []" in plan  # what is in force is settled by the folders alone
    assert table._rows(table.view(2)).where("v LIKE 'new%'").count() == 0
    # two buckets of the full load and of the append each, and the first rewrite of the bucket of row 5
    assert table.vacuum(1) == 5 and table.vacuum(1) == 0
    assert table.read().count() == 900


def test_a_try_that_was_never_published_leaves_no_rows(spark, folder):
    table = VersionedTable(spark, folder, spark.range(1).schema, ["id"], buckets=4)
    table.publish(table.stage_upsert(spark.range(10)), "r1")
    table.stage_append(spark.range(100, 150))
    assert table.read().count() == 10
    table.publish(table.stage_append(spark.range(200, 203)), "r2")
    assert sorted(r.id for r in table.read().collect()) == [*range(10), 200, 201, 202]
    empty = VersionedTable(spark, f"{folder}-empty", spark.range(1).schema, ["id"])
    empty.publish(empty.stage_upsert(spark.range(0)), "r1")
    assert empty.read().count() == empty.count() == 0 and empty.commit_of("r1")["version"] == 1


def test_a_late_batch_does_not_replace_newer_rows(spark, source, folder):
    newer = source.withColumn("name", F.lit("new")).withColumn("updated_at", F.expr("updated_at + interval 1 year"))
    target = VersionedTable(spark, f"{folder}/late", source.schema, ["id"])
    for i, rows in enumerate([newer, source]):
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/late-in")
        stream = spark.readStream.schema(source.schema).parquet(f"{folder}/late-in")
        stream_upsert(stream, target, ["id"], f"{folder}/late-checkpoint", ["updated_at"], name=f"late{i}")
    assert target.count() == target.read().where("name = 'new'").count() == 20


def test_a_table_starts_when_its_own_parents_end():
    """b waits for a alone, not for the slow c of its level; entries with one target follow each other."""
    plan = Plan({"a": 0, "c": 0, "x": 0, "b": 1, "d": 2}, [], [], {"a": [], "c": [], "x": [], "b": ["a"], "d": ["b"]})
    done, began, lock = threading.Event(), [], threading.Lock()

    def run(name):
        with lock:
            began.append(name)
        if name == "c":
            assert done.wait(20), "d did not start before c ended"
        if name == "d":
            done.set()
        return {"name": name}

    names = [r["name"] for r in run_by_edges(plan, {"a": "a", "b": "b", "c": "c", "d": "d", "x": "b"}, run, 2)]
    assert began[0] == "a" and names.index("d") < names.index("c")  # a has the longest way below it
    assert names.index("x") < names.index("b")  # the same target: in the order of the plan
    with pytest.raises(RuntimeError, match="boom"):
        run_by_edges(plan, dict.fromkeys("abcdx", "t"), lambda name: (_ for _ in ()).throw(RuntimeError("boom")), 2)


def test_repeats_in_a_stream_never_reach_the_target(spark, folder):
    """Rows seen before are dropped by the stream, across a restart too; changed ones and newer ones that come late are not."""
    layout = "id int, at timestamp, v string"

    def rows(*some):
        return spark.createDataFrame([(i, dt.datetime(2026, 1, 1, h), v) for i, h, v in some], layout)

    target = VersionedTable(spark, f"{folder}/t", rows().schema, ["id"])

    def arrive(number, df):
        df.coalesce(1).write.parquet(f"{folder}/in/{number}")
        stream = spark.readStream.schema(layout).parquet(f"{folder}/in/*")
        stream_upsert(stream, target, ["id"], f"{folder}/checkpoint", ["at"], name="watched", event_time="at", horizon="6 hours")
        return target.view().version, {r.id: r.v for r in target.read().collect()}

    first = arrive(0, rows((1, 8, "a"), (2, 9, "b"), (2, 9, "b")))
    assert first == (1, {1: "a", 2: "b"})
    assert arrive(1, rows((1, 8, "a"), (2, 9, "b"))) == first  # nothing is written
    again = arrive(2, rows((1, 8, "a"), (2, 7, "late"), (1, 9, "newer")))
    assert again == (2, {1: "newer", 2: "b"})
    with pytest.raises(ValueError, match="go together"):
        stream_upsert(None, target, ["id"], folder, event_time="at")
