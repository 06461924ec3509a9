"""Audit trail: table traces and error records as queryable tables."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.functions.ids import table_id
from ferryline.functions.text import redact

TRACE_SCHEMA = """
    run_id string, table_run_id string, table_id string, load_order int, level int,
    source struct<schema:string, name:string>, target struct<schema:string, name:string>,
    migration_type string, status string, reason string, records_processed bigint,
    start_time timestamp_ntz, end_time timestamp_ntz, duration_ms bigint,
    incremental struct<column:string, previous_value:string, last_value:string, state_updated:boolean>,
    metrics struct<write_mode:string, source_selected:bigint, target_before:bigint, target_after:bigint,
                   target_net_delta:bigint, consistency:string, outcome:string, warnings:array<string>>,
    errors array<string>
"""

# Severity and status of an error record.
SEVERITY, STATUS = "ERROR", "FAILED"


def _safe(traces: DataFrame) -> DataFrame:
    """Traces whose messages have lost their secrets."""
    def clean(texts):
        return F.transform(texts, redact)

    return (
        traces.withColumn("reason", F.when(F.col("reason").isNotNull(), redact(F.col("reason"))))
        .withColumn("errors", clean(F.col("errors")))
        .withColumn("metrics", F.col("metrics").withField("warnings", clean(F.col("metrics.warnings"))))
    )


def write_trace(traces: DataFrame, path: str) -> None:
    """Append trace rows, one folder per run."""
    _safe(traces).write.mode("append").partitionBy("run_id").json(path)


def write_table_trace(trace: DataFrame, path: str, run_id: str, entry: str) -> None:
    """The trace of one entry in one run, in a folder of its own: a run started again replaces it."""
    folder = f"{path}/run_id={quote(run_id, safe='')}/entry={quote(entry, safe='')}"
    _safe(trace).drop("run_id").write.mode("overwrite").json(folder)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    names = [f.name for f in T.DataType.fromDDL(TRACE_SCHEMA)]
    return spark.read.schema(TRACE_SCHEMA).json(path).select(*names)


def error_rows(failures: DataFrame) -> DataFrame:
    """Error records from (at, run_id, table_run_id, phase, table_schema, table_name, error_type, message, context)."""
    table = F.when(F.col("table_name").isNotNull(), table_id(F.col("table_schema"), F.col("table_name")))
    return failures.select(
        "at", "run_id", "table_run_id", "phase",
        F.lit(SEVERITY).alias("severity"), F.lit(STATUS).alias("status"),
        table.alias("table_id"),
        F.coalesce("error_type", F.lit("UnknownException")).alias("error_type"),
        redact(F.col("message")).alias("message"),
        "context",
    )


def write_errors(failures: DataFrame, path: str) -> None:
    error_rows(failures).write.mode("append").json(path)


def read_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Error records of a log that may have been rolled: a line counts once."""
    return spark.read.schema(schema).json(path).distinct()
