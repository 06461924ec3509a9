import pytest

from ferryline.operators import reconcile as R

COUNTS = "write_mode string, source_selected bigint, target_before bigint, target_after bigint"


@pytest.mark.parametrize("mode, selected, before, after, consistency, outcome, processed, status", [
    ("UPSERT", 0, 5, 5, "CONSISTENT", "NO_SOURCE_ROWS", 0, "SUCCESS"),
    ("UPSERT", 0, 5, 6, "INCONSISTENT", "UNAVAILABLE", 0, "FAILED"),
    ("INSERT", 0, 5, 4, "INCONSISTENT", "UNAVAILABLE", 0, "FAILED"),
    ("UPSERT", 20, 5, 4, "INCONSISTENT", "UNAVAILABLE", 0, "FAILED"),
    ("INSERT", 20, 0, 20, "CONSISTENT", "INSERT_APPLIED", 20, "SUCCESS"),
    ("INSERT", 20, 0, 12, "INCONSISTENT", "UNAVAILABLE", 0, "FAILED"),
    ("UPSERT", 20, 0, 21, "INCONSISTENT", "UNAVAILABLE", 0, "FAILED"),
    ("UPSERT", 20, 0, 20, "CONSISTENT", "UPSERT_INSERTS_ONLY", 20, "SUCCESS"),
    ("UPSERT", 20, 10, 22, "CONSISTENT", "UPSERT_INSERTS_AND_UPDATES", 20, "SUCCESS"),
    ("UPSERT", 20, 20, 20, "CONSISTENT", "UPSERT_NO_NET_CHANGE", 20, "SUCCESS"),
    ("UPSERT", 20, None, 20, "SOURCE_ONLY", "SOURCE_COUNT_ONLY", 20, "SUCCESS"),
    ("UPSERT", 0, None, None, "SOURCE_ONLY", "NO_SOURCE_ROWS", 0, "SUCCESS"),
    ("UPSERT", None, 5, 9, "TARGET_DELTA_ONLY", "TARGET_DELTA_ONLY", 4, "SUCCESS"),
    ("UPSERT", None, 9, 5, "TARGET_DELTA_ONLY", "TARGET_DELTA_ONLY", 0, "SUCCESS"),
    ("INSERT", None, None, 5, "UNAVAILABLE", "UNAVAILABLE", 0, "SUCCESS"),
])
def test_audit_table(spark, mode, selected, before, after, consistency, outcome, processed, status):
    row = R.audit(spark.createDataFrame([(mode, selected, before, after)], COUNTS)).first()
    assert (row.consistency, row.outcome, row.records_processed, row.status) == (consistency, outcome, processed, status)


@pytest.mark.parametrize("kind, strategy, mode", [
    (None, "append", "UPSERT"), ("full", "append", "UPSERT"), (" Incremental ", None, "UPSERT"),
    ("incremental", " ", "UPSERT"), ("incremental", "APPEND", "INSERT"), ("incremental", "append_only", "INSERT"),
    ("incremental", "upsert", "UPSERT"),
])
def test_write_mode(spark, kind, strategy, mode):
    df = spark.createDataFrame([(kind, strategy)], "kind string, strategy string")
    assert df.select(R.write_mode(df.kind, df.strategy)).first()[0] == mode


def test_run_summary_counts_only_final_statuses(spark, rows):
    layout = "run_id string, load_order int, table_id string, status string, reason string, records_processed bigint, duration_ms bigint"
    traces = spark.createDataFrame([
        ("r", 1, "a", "SUCCESS", None, 5, 10), ("r", 2, "b", "FAILED", "x", 0, 3), ("r", 3, "c", "BLOCKED", "b", 0, 0),
        ("r", 4, "d", "PENDING", None, 0, 0)], layout)
    assert rows(R.run_summary(traces)) == [("r", 4, 1, 1, 1, 5, 13)]
    assert rows(R.run_failures(traces)) == [("r", 2, "b", "FAILED", "x"), ("r", 3, "c", "BLOCKED", "b")]
    assert [r[0] for r in traces.select(R.final_status(traces.status)).collect()] == ["SUCCESS", "FAILED", "BLOCKED", "FAILED"]
