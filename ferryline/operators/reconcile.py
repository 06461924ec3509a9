"""Verdict over a load: write mode, audit of row counts, status, run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ferryline.functions import ids
from ferryline.session import one_row

# Statuses, consistency verdicts and outcomes.
SUCCESS, FAILED, BLOCKED = "SUCCESS", "FAILED", "BLOCKED"
CONSISTENT, INCONSISTENT = "CONSISTENT", "INCONSISTENT"
SOURCE_ONLY, TARGET_DELTA_ONLY, UNAVAILABLE = "SOURCE_ONLY", "TARGET_DELTA_ONLY", "UNAVAILABLE"
APPEND_STRATEGIES = ["append", "append_only"]


def write_mode(migration_type: Column, load_strategy: Column) -> Column:
    """INSERT for an incremental append, UPSERT for everything else."""
    kind = F.coalesce(ids.normalize(migration_type), F.lit("full"))
    strategy = F.when(ids.is_blank(load_strategy), "upsert").otherwise(ids.normalize(load_strategy))
    return F.when((kind == "incremental") & strategy.isin(APPEND_STRATEGIES), "INSERT").otherwise("UPSERT")


def net_delta(before: Column, after: Column) -> Column:
    """Rows gained by the target; null if either count is unknown."""
    return after - before


def consistency(mode: Column, selected: Column, delta: Column) -> Column:
    both = selected.isNotNull() & delta.isNotNull()
    wrong = (
        ((selected == 0) & (delta != 0))
        | (delta < 0)
        | ((mode == "INSERT") & (delta != selected))
        | (delta > selected)
    )
    return (
        F.when(both & wrong, INCONSISTENT)
        .when(both, CONSISTENT)
        .when(selected.isNotNull(), SOURCE_ONLY)
        .when(delta.isNotNull(), TARGET_DELTA_ONLY)
        .otherwise(UNAVAILABLE)
    )


def outcome(mode: Column, selected: Column, delta: Column) -> Column:
    verdict = consistency(mode, selected, delta)
    return (
        F.when(verdict.isin(INCONSISTENT, UNAVAILABLE), "UNAVAILABLE")
        .when(verdict == TARGET_DELTA_ONLY, "TARGET_DELTA_ONLY")
        .when(selected == 0, "NO_SOURCE_ROWS")
        .when(verdict == SOURCE_ONLY, "SOURCE_COUNT_ONLY")
        .when(mode == "INSERT", "INSERT_APPLIED")
        .when(delta == selected, "UPSERT_INSERTS_ONLY")
        .when(delta > 0, "UPSERT_INSERTS_AND_UPDATES")
        .otherwise("UPSERT_NO_NET_CHANGE")
    )


def processed(selected: Column, delta: Column) -> Column:
    """Rows a load accounts for: the selection, else a gain of the target, else 0."""
    return F.coalesce(selected, F.greatest(delta, F.lit(0)), F.lit(0)).cast("bigint")


def audit(rows: DataFrame) -> DataFrame:
    """Verdict per load, from (write_mode, source_selected, target_before, target_after)."""
    mode, selected, delta = F.col("write_mode"), F.col("source_selected"), F.col("target_net_delta")
    verdict = consistency(mode, selected, delta)
    return (
        rows.withColumn("target_net_delta", net_delta(F.col("target_before"), F.col("target_after")))
        .withColumn("consistency", verdict)
        .withColumn("outcome", outcome(mode, selected, delta))
        .withColumn("records_processed", F.when(verdict == INCONSISTENT, 0).otherwise(processed(selected, delta)))
        .withColumn("status", F.when(verdict == INCONSISTENT, FAILED).otherwise(SUCCESS))
    )


def audit_counts(spark: SparkSession, mode: str, selected: int | None, before: int | None, after: int | None) -> Row:
    """The verdict on one load whose counts are at hand."""
    def count(value):
        return F.lit(value).cast("bigint")

    row = one_row(spark, write_mode=F.lit(mode), source_selected=count(selected), target_before=count(before),
                  target_after=count(after))
    return audit(row).first()


def final_status(status: Column) -> Column:
    """One of the three final statuses; anything else has failed."""
    return F.when(status.isin(SUCCESS, FAILED, BLOCKED), status).otherwise(FAILED)


def run_summary(traces: DataFrame) -> DataFrame:
    """Totals per run, recounted from its table rows."""
    def tally(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return traces.groupBy("run_id").agg(
        F.count("*").alias("total"),
        tally(SUCCESS).alias("successful"),
        tally(FAILED).alias("failed"),
        tally(BLOCKED).alias("blocked"),
        F.sum("records_processed").alias("records"),
        F.sum("duration_ms").alias("duration_ms"),
    )


def run_failures(traces: DataFrame) -> DataFrame:
    """Failed tables with their reason and blocked tables, one row each, in load order."""
    stopped = traces.where(F.col("status").isin(FAILED, BLOCKED))
    return stopped.select("run_id", "load_order", "table_id", "status", "reason")


def selected_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def target_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of a target before and after a load, and the difference."""
    old = before.agg(F.count("*").alias("target_before"))
    new = after.agg(F.count("*").alias("target_after"))
    # Two one-row aggregates: a scalar subquery, not a product of tables.
    return new.select(old.scalar().alias("target_before"), "target_after").withColumn(
        "target_net_delta", net_delta(F.col("target_before"), F.col("target_after"))
    )
