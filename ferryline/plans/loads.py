"""One table, one load: select, check, write, audit, publish, remember.

The order is write, audit, publish, state.  A target never shows a load that
was rejected or failed its audit, and a load that died half way can be started
again under its run id.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.operators import selection
from ferryline.operators.keys import key_duplicates, orphan_counts, orphans
from ferryline.operators.merge import clean_keys
from ferryline.operators.reconcile import INCONSISTENT, SUCCESS, audit, audit_counts
from ferryline.operators.rows import VIOLATIONS, check_rows, is_rejected
from ferryline.plans.contract import TableLoad
from ferryline.session import materialize, one_row
from ferryline.sources.state import saved_cursor, write_state
from ferryline.sources.tables import Staged, VersionedTable


WAVE = 256  # batches of a drain that are written at a time
BATCH = "load_batch"


class LoadFailed(RuntimeError):
    """A load that was not published; `result` holds what was measured so far."""

    def __init__(self, message: str, result: LoadResult):
        super().__init__(message)
        self.result = result


@dataclass
class LoadResult:
    write_mode: str
    source_selected: int | None = None
    target_before: int | None = None
    target_after: int | None = None
    target_net_delta: int | None = None
    consistency: str | None = None
    outcome: str | None = None
    records_processed: int = 0
    previous_value: str | None = None
    last_value: str | None = None
    state_updated: bool = False
    published_before: bool = False
    warnings: list[str] = field(default_factory=list)


def full_load(load: TableLoad, source: DataFrame, target: VersionedTable, run_id: str,
              parents: dict[str, DataFrame] | None = None, rejects_path: str | None = None) -> LoadResult:
    """Upsert the whole (filtered) source on the target's primary key; running it again changes nothing.

    The source is read once to check and count it and once to write it; the key
    columns alone are read once more.  That is right for files.  With
    `load.snapshot` it is read once and the rest works on the copy.
    """
    result = LoadResult("UPSERT")
    keys = clean_keys(load.schema.primary_key)
    done = target.commit_of(run_id, load.entry)
    if done:
        return _already_published(result, target, done)
    selected = selection.where(source, load.where)
    if load.snapshot:
        selected = materialize(selected, "snapshot")
    good = _accept(load, selected, result, parents or {}, rejects_path)
    # a NULL in a primary key is rejected
    staged = target.stage_upsert(good, keys, load.order_by, keys_set=True, n_rows=result.source_selected)
    _finish(load, target, staged, result, run_id)
    return result


def incremental_load(load: TableLoad, source: DataFrame, target: VersionedTable, run_id: str, state_path: str,
                     parents: dict[str, DataFrame] | None = None, rejects_path: str | None = None,
                     with_ties: bool = True) -> LoadResult:
    """One batch beyond the saved cursor, appended or upserted; the cursor moves last.

    The batch is written to the shared folder once and then counted, merged and
    measured from there, so all of these see the same rows.  `with_ties` keeps
    the rows tied with the last cursor in the batch; without it a tie at the cut
    is never completed.
    """
    spec = load.incremental
    spark = source.sparkSession
    result = LoadResult("INSERT" if spec.appends else "UPSERT")
    state_key = load.target.id
    start = saved_cursor(spark, state_path, state_key) or spec.start_value
    result.previous_value = result.last_value = start
    done = target.commit_of(run_id, load.entry)
    if done:  # published before, perhaps without its state; a saved cursor only ever moves ahead
        if done["cursor"] and selection.is_later(source, spec.column, done["cursor"], start):
            _save_cursor(spark, load, result, state_path, run_id, done["cursor"])
        return _already_published(result, target, done)

    size = spec.batch_size or selection.DEFAULT_BATCH
    pick = selection.next_batch_with_ties if with_ties else selection.next_batch
    batch = materialize(pick(source, spec.column, start, size, load.where), "batch")
    good = _accept(load, batch, result, parents or {}, rejects_path)
    if spec.appends:
        _forbid_taken_keys(load, good, target, result)
        staged = target.stage_append(good, result.source_selected)
    else:
        keys = clean_keys(spec.keys or load.schema.primary_key)
        order = load.order_by or [spec.column]
        staged = target.stage_upsert(good, keys, order, small_batch=True, keys_set=set(keys) <= set(load.schema.primary_key),
                                     n_rows=result.source_selected)
    last = selection.last_cursor(batch, spec.column)
    _finish(load, target, staged, result, run_id, cursor=last)
    if last and last.strip():
        _save_cursor(spark, load, result, state_path, run_id, last)
    return result


def incremental_loads(load: TableLoad, source: DataFrame, target: VersionedTable, run_id: str, state_path: str,
                      **options) -> list[LoadResult]:
    """Batches until none is left; started again under its run id it goes on behind those it had published."""
    results: list[LoadResult] = []
    together = _can_go_together(load, target) and options.get("with_ties", True)
    while not results or results[-1].published_before or results[-1].source_selected:
        if together and target.commit_of(f"{run_id}.{len(results) + 1}", load.entry) is None:
            _load_waves(load, source, target, run_id, state_path, options, results)
        results.append(incremental_load(load, source, target, f"{run_id}.{len(results) + 1}", state_path, **options))
    return results


def _can_go_together(load: TableLoad, target: VersionedTable) -> bool:
    """Whether batches that are right together are right one by one: rows are only added, and none may wait for a later one."""
    own = any(fk.parent == load.target.id for fk in load.schema.foreign_keys)
    return load.incremental.appends and not own and not target.enforces_constraints


def _load_waves(load: TableLoad, source: DataFrame, target: VersionedTable, run_id: str, state_path: str, options: dict,
                results: list[LoadResult]) -> None:
    """The batches of what is beyond the cursor now, added to `results`: `WAVE` of them are checked, written and published at a time.

    What is beyond the cursor is copied once, in the order of the cursor, so that a wave
    reads its own rows only.  A wave that breaks a rule is halved down to the batch that
    does, which then fails as it would alone; those before it are published.
    """
    spec, spark = load.incremental, source.sparkSession
    size = spec.batch_size or selection.DEFAULT_BATCH
    start = saved_cursor(spark, state_path, load.target.id) or spec.start_value
    beyond = selection.where(selection.after_cursor(source, spec.column, start), load.where)
    ordered = materialize(beyond.repartitionByRange(spec.column).sortWithinPartitions(spec.column), "beyond")
    stretches = selection.stretches(ordered, spec.column, WAVE * size)
    for number, stretch in enumerate(stretches, 1):
        ends, rest = selection.batch_ends(selection.between_cursors(ordered, spec.column, start, stretch), spec.column, size)
        if rest and number == len(stretches):  # otherwise the next stretch begins with them
            ends.append(rest)
        many = WAVE
        while ends:
            wave, names = ends[:many], [f"{run_id}.{len(results) + i}" for i in range(1, len(ends[:many]) + 1)]
            done = _load_wave(load, ordered, target, names, state_path, start, wave, options.get("parents") or {})
            if not done and len(wave) > 1:
                many = len(wave) // 2
                continue
            results += done or [incremental_load(load, ordered, target, names[0], state_path, **options)]
            start, ends = wave[-1], ends[len(wave):]


def _load_wave(load: TableLoad, ordered: DataFrame, target: VersionedTable, names: list[str], state_path: str, start: str,
               ends: list[str], parents: dict[str, DataFrame]) -> list[LoadResult]:
    """Batches appended in one pass; none, and nothing published, if they break a rule."""
    spec, spark, key = load.incremental, target.spark, load.schema.primary_key
    rows = selection.between_cursors(ordered, spec.column, start, ends[-1])
    numbered = replace(load.schema, columns=T.StructType([*load.schema.columns.fields, T.StructField(BATCH, T.IntegerType())]))
    checked = check_rows(rows.withColumn(BATCH, selection.batch_number(rows, spec.column, ends)), numbered)
    counts = {r[BATCH]: r for r in checked.groupBy(BATCH).agg(F.count("*").alias("n"), F.count_if(is_rejected()).alias("bad")).collect()}
    if any(r["bad"] for r in counts.values()) or any(_orphans_per_key(load, checked, parents).values()):
        return []
    good, selected = checked.drop(VIOLATIONS), [counts[i]["n"] for i in range(len(ends))]
    probe = LoadResult("INSERT")
    try:
        _forbid_taken_keys(load, good.drop(BATCH), target, probe)
        staged = target.stage_appends(good, BATCH, selected)
        _check_merged(load, target, staged[-1], probe)
    except LoadFailed:
        return []
    counted = spark.createDataFrame([(i, "INSERT", n, s.rows_before, s.rows_after) for i, (n, s) in enumerate(zip(selected, staged))],
                                    "i int, write_mode string, source_selected bigint, target_before bigint, target_after bigint")
    verdicts = audit(counted).orderBy("i").collect()
    if any(v["consistency"] == INCONSISTENT for v in verdicts):
        return []
    target.publish_all(staged, names, ends, load.entry, selected)
    results = [LoadResult(v["write_mode"], v["source_selected"], v["target_before"], v["target_after"], v["target_net_delta"],
                          v["consistency"], v["outcome"], v["records_processed"], previous, last)
               for v, previous, last in zip(verdicts, [start, *ends], ends)]
    _save_cursors(spark, load, results, state_path, names)
    return results


def _already_published(result: LoadResult, target: VersionedTable, done: dict) -> LoadResult:
    result.target_before = result.target_after = target.count()
    result.target_net_delta, result.source_selected = 0, None
    result.published_before = True
    result.consistency, result.outcome = "TARGET_DELTA_ONLY", "TARGET_DELTA_ONLY"
    result.warnings.append("this run had published the table before; nothing was written")
    return result


def _accept(load: TableLoad, selected: DataFrame, result: LoadResult, parents: dict[str, DataFrame],
            rejects_path: str | None) -> DataFrame:
    """The selection in the target's shape; one row that breaks a rule fails the load."""
    checked = check_rows(selected, load.schema)
    result.source_selected, rejected = checked.agg(F.count("*"), F.count_if(is_rejected())).first()
    missing = _orphans_per_key(load, checked, parents)
    if rejected or any(missing.values()):
        if rejects_path:
            _write_rejects(load, checked, parents, missing, rejects_path)
        lost = ", ".join(f"{n} rows without a parent for {c}" for c, n in missing.items() if n)
        broken = f"{rejected} rows break a column rule" if rejected else ""
        raise LoadFailed("; ".join(filter(None, [broken, lost])), result)
    return checked.drop(VIOLATIONS)


def _orphans_per_key(load: TableLoad, rows: DataFrame, parents: dict[str, DataFrame]) -> dict[str, int]:
    """Rows without a parent for each foreign key whose parent table is at hand; one job for all of them."""
    counts = [
        orphan_counts(rows, parents[fk.parent], fk.column, fk.parent_column).select(
            F.lit(fk.column).alias("fk"), "n_rows").groupBy("fk").agg(F.sum("n_rows").alias("n_rows"))
        for fk in load.schema.foreign_keys if fk.parent in parents and fk.parent != load.target.id
    ]
    return {r["fk"]: r["n_rows"] for r in reduce(DataFrame.union, counts).collect()} if counts else {}


def _write_rejects(load: TableLoad, checked: DataFrame, parents: dict, missing: dict, path: str) -> None:
    checked.where(is_rejected()).write.mode("append").json(path)
    for fk in load.schema.foreign_keys:
        if missing.get(fk.column):
            lost = orphans(checked.where(~is_rejected()), parents[fk.parent], fk.column, fk.parent_column)
            rule = F.array(F.struct(F.lit("orphan").alias("rule"), F.lit(fk.column).alias("column")))
            lost.withColumn(VIOLATIONS, rule).write.mode("append").json(path)


def _forbid_taken_keys(load: TableLoad, batch: DataFrame, target: VersionedTable, result: LoadResult) -> None:
    keys = load.schema.primary_key
    if not keys or target.enforces_constraints:
        return
    if not key_duplicates(batch, keys).isEmpty():
        raise LoadFailed("an INSERT batch repeats a primary key", result)
    stored = target.read_near(batch) if keys == target.keys else target.read()
    if not stored.join(batch.select(*keys), keys, "left_semi").isEmpty():
        raise LoadFailed("an INSERT batch holds primary keys the target already has", result)


def _finish(load: TableLoad, target: VersionedTable, staged: Staged, result: LoadResult, run_id: str,
            cursor: str | None = None) -> None:
    """Audit what was written and publish it if the audit holds."""
    if not target.enforces_constraints:
        _check_merged(load, target, staged, result)
    result.target_before, result.target_after = staged.rows_before, staged.rows_after
    verdict = audit_counts(target.spark, result.write_mode, result.source_selected, staged.rows_before, staged.rows_after)
    result.target_net_delta = verdict["target_net_delta"]
    result.consistency, result.outcome = verdict["consistency"], verdict["outcome"]
    if result.consistency == INCONSISTENT:
        raise LoadFailed(
            f"source and target disagree: {result.write_mode} of {result.source_selected} rows, "
            f"target {result.target_before} -> {result.target_after}", result)
    result.records_processed = verdict["records_processed"]
    target.publish(staged, run_id, cursor, load.entry, result.source_selected)


def _check_merged(load: TableLoad, target: VersionedTable, staged: Staged, result: LoadResult) -> None:
    """UNIQUE columns and keys to the table itself, on the rows as they would be published."""
    for column in load.schema.unique:
        if not key_duplicates(target.staged_rows(staged), [column]).isEmpty():
            raise LoadFailed(f"values of the unique column {column} repeat", result)
    for fk in load.schema.foreign_keys:
        if fk.parent == load.target.id:
            rows = target.staged_rows(staged)
            if not orphan_counts(rows, rows, fk.column, fk.parent_column).isEmpty():
                raise LoadFailed(f"rows without a parent for {fk.column}", result)


def _save_cursor(spark: SparkSession, load: TableLoad, result: LoadResult, path: str, run_id: str, last: str) -> None:
    result.last_value = last
    _save_cursors(spark, load, [result], path, [run_id])


def _save_cursors(spark: SparkSession, load: TableLoad, results: list[LoadResult], path: str, run_ids: list[str]) -> None:
    """A state for each load, the later ones a microsecond later."""
    spec, now = load.incremental, F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")  # UTC never repeats
    saved = F.explode(F.array(*[F.struct(
        F.lit(r.previous_value).alias("previous_value"), F.lit(r.last_value).alias("last_value"), F.lit(run_id).alias("run_id"),
        F.lit(f"{run_id}-{load.target.id}").alias("table_run_id"), F.lit(r.records_processed).cast("bigint").alias("records_processed"),
        F.lit(i).alias("place")) for i, (r, run_id) in enumerate(zip(results, run_ids, strict=True))]))
    rows = one_row(spark, s=saved).select(
        F.lit(load.target.id).alias("state_key"), F.lit(load.source.id).alias("source_table"), F.lit(load.target.id).alias("target_table"),
        F.lit(spec.column).alias("column_name"), "s.previous_value", "s.last_value", F.lit(spec.batch_size).cast("bigint").alias("batch_size"),
        F.lit(SUCCESS).alias("status"), "s.run_id", "s.table_run_id", "s.records_processed",
        (now + F.make_dt_interval(secs=F.col("s.place") / 1_000_000)).alias("updated_at"))
    write_state(rows, path)
    for result in results:
        result.state_updated = True
