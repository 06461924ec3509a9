"""Upsert micro-batches into a versioned target, and find late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.operators.digests import missing_by_digest, range_digests
from ferryline.operators.merge import clean_keys, without
from ferryline.operators.reconcile import INCONSISTENT, audit_counts
from ferryline.operators.selection import _literal
from ferryline.session import materialize
from ferryline.sources.tables import VersionedTable


def stream_upsert(stream: DataFrame, target: VersionedTable, keys: list[str], checkpoint: str,
                  order_by: list[str] | None = None, name: str = "stream", event_time: str | None = None,
                  horizon: str | None = None):
    """Take what has arrived, batch by batch, and stop; returns the query.

    The checkpoint replaces the saved cursor.  A batch that is delivered again
    is recognised by its id in the commit log, so a restart writes nothing twice.
    With `order_by` a row that arrives late never replaces a newer one.

    With `event_time` and a `horizon` (such as "2 hours") rows that came before, alike in every
    column, are dropped by the stream's state and never reach the target; a row that differs in any
    column passes.  The state is bounded by the horizon: a row that lies further back than that behind
    the newest of the batches before is dropped as well, and left to `late_rows`.
    """
    keys = clean_keys(keys)
    if (event_time is None) != (horizon is None):
        raise ValueError("an event time and a horizon go together")
    if event_time:
        stream = stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark()

    def step(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{name}-{batch_id}"
        if target.commit_of(run_id):
            return
        rows = materialize(batch, "micro-batch")
        n_rows = rows.count()  # of the written files' footers
        if not n_rows:
            return
        staged = target.stage_upsert(rows, keys, order_by, small_batch=True, keep_newer=True, n_rows=n_rows)
        verdict = audit_counts(rows.sparkSession, "UPSERT", n_rows, staged.rows_before, staged.rows_after)
        if verdict["consistency"] == INCONSISTENT:
            raise RuntimeError(f"batch {batch_id}: source and target disagree: {verdict}")
        target.publish(staged, run_id)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    query = writer.queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_rows(source: DataFrame, target: DataFrame, cursor: str, last, keys: list[str]) -> DataFrame:
    """Source rows at or before the saved cursor that the target does not have."""
    passed = source.where(F.col(cursor) <= _literal(source, cursor, last))
    return without(passed, target, keys)


def keep_digests(target: DataFrame, cursor: str, last, keys: list[str], width: float, path: str) -> None:
    """Write the digests of what the target holds up to the saved cursor, for later checks."""
    held = target.where(F.col(cursor) <= _literal(target, cursor, last))
    range_digests(held, cursor, keys, width).write.mode("overwrite").parquet(path)


def late_rows_by_digest(source: DataFrame, target: DataFrame, cursor: str, last, keys: list[str], widths: list[float],
                        kept: DataFrame | None = None) -> DataFrame:
    """The same rows as `late_rows`, for a long past that rarely changes.

    Ranges of the cursor are compared by digests first, those kept by `keep_digests` or fresh
    ones; only where they differ are rows of either side joined.  With digests kept
    an unchanged past opens no file of the target.
    """
    passed = source.where(F.col(cursor) <= _literal(source, cursor, last))
    return missing_by_digest(passed, target.where(F.col(cursor) <= _literal(target, cursor, last)), target, cursor, keys, widths, kept)
