"""Incremental state: one saved cursor per target, kept as an append-only table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_SCHEMA = """
    state_key string, source_table string, target_table string, column_name string,
    previous_value string, last_value string, batch_size bigint, status string,
    run_id string, table_run_id string, records_processed bigint, updated_at timestamp_ntz
"""


def latest_state(records: DataFrame, key: str = "state_key", updated: str = "updated_at",
                 tie_break: list[str] | None = None) -> DataFrame:
    """The last record written for each key (pre-aggregated per task, so a hot key is cheap)."""
    rest = [c for c in records.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(updated, *(tie_break or []))).alias("_last")
    return records.groupBy(key).agg(newest).select(key, "_last.*")


def worth_saving(records: DataFrame) -> DataFrame:
    """Records that carry a new cursor; a blank one never replaces what is saved."""
    return records.where(F.length(F.trim("last_value")) > 0)


def write_state(records: DataFrame, path: str) -> None:
    worth_saving(records).write.mode("append").json(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The saved cursor of every target; empty before the first save."""
    try:
        records = spark.read.schema(STATE_SCHEMA).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        records = spark.createDataFrame([], STATE_SCHEMA)
    return latest_state(records)


def saved_cursor(spark: SparkSession, path: str, key: str) -> str | None:
    row = read_state(spark, path).where(F.col("state_key") == key).select("last_value").first()
    return row[0] if row else None
