"""Logs keep their lines and few files, whatever runs meanwhile."""

from pyspark.sql import functions as F

from ferryline.session import files_in, one_row
from ferryline.sources.audit_log import read_errors
from ferryline.sources.logs import roll_log
from ferryline.sources.state import STATE_SCHEMA, read_state, saved_cursor
from ferryline.sources.tables import VersionedTable


def parts(spark, path):
    return [name for name in files_in(spark, path) if name.startswith("part")]


def put(spark, path, count, of="k"):
    rows = spark.range(count).select(F.concat(F.lit(of), F.col("id") % 5).alias("state_key"), F.col("id").cast("string").alias("last_value"),
                                     (F.timestamp_seconds(F.col("id"))).cast("timestamp_ntz").alias("updated_at"))
    rows.repartition(count, "last_value").write.option("maxRecordsPerFile", 1).mode("append").json(path)


def test_200_loads_leave_few_files(spark, folder):
    path = f"{folder}/state"
    put(spark, path, 200)
    before = sorted(map(tuple, read_state(spark, path).collect()), key=str)
    small = len(parts(spark, path))  # Spark may add an empty one
    assert small >= 200 and roll_log(spark, path) == small
    early = spark.read.schema(STATE_SCHEMA).json(path)  # a reader that has listed all files of now
    assert len(parts(spark, path)) == small + 1 and sorted(map(tuple, read_state(spark, path).collect()), key=str) == before
    assert roll_log(spark, path) == 0 and early.count() == 400  # nothing goes within the grace time
    put(spark, path, 2, of="new")  # appended meanwhile
    assert roll_log(spark, path, grace=0) == 0 and len(parts(spark, path)) <= 4
    assert saved_cursor(spark, path, "new1") == "1" and saved_cursor(spark, path, "k4") == "199"
    assert 3 <= roll_log(spark, path, few=1, grace=0) <= 4  # the rolled file is rolled again while it is small
    assert roll_log(spark, path, few=1, grace=0) == 0 and len(parts(spark, path)) == 1
    assert spark.read.schema(STATE_SCHEMA).json(path).count() == 202


def test_a_call_that_died_leaves_lines_that_count_once(spark, folder):
    path = f"{folder}/errors"
    for message in "abc":
        one_row(spark, at=F.lit("2026-01-01"), message=F.lit(message)).write.mode("append").json(path)
    spark.read.text(path).coalesce(1).write.mode("append").text(path)  # copied, but no note was left
    assert roll_log(spark, path, few=2, grace=0) == 4
    errors = read_errors(spark, path, "at string, message string")
    assert sorted(r.message for r in errors.collect()) == ["a", "b", "c"]
    assert roll_log(spark, f"{folder}/none") == 0


def test_commits_are_rolled_by_vacuum(spark, folder, monkeypatch):
    from ferryline.sources import logs

    monkeypatch.setattr(logs.roll_log, "__defaults__", (2, 0.0))
    table = VersionedTable(spark, folder, spark.range(1).schema, ["id"], buckets=4)
    for i in range(5):
        table.publish(table.stage_append(spark.range(i * 10, i * 10 + 10)), f"r{i}")
    for _ in range(2):
        table.vacuum()
        assert table.count() == table.read().count() == 50 and table.commit_of("r2")["version"] == 3
    assert len(parts(spark, f"{folder}/commits")) == 1
