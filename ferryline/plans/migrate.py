"""A whole contract: parents first, failures block what depends on them, all of it traced."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, replace
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.operators.blocks import on_cycles
from ferryline.operators.edges import included_edges, map_edges
from ferryline.operators.reconcile import BLOCKED, FAILED, SUCCESS
from ferryline.operators.rows import TargetSchema
from ferryline.operators.schema_diff import schema_diff
from ferryline.plans.contract import TableLoad, validate
from ferryline.plans.loads import LoadFailed, LoadResult, full_load, incremental_load
from ferryline.sources.audit_log import TRACE_SCHEMA, read_trace, write_errors, write_table_trace
from ferryline.sources.catalog import declared_catalog
from ferryline.sources.logs import roll_log
from ferryline.sources.tables import VersionedTable

FK_SCHEMA = "pk_schema string, pk_table string, fk_schema string, fk_table string"
ERROR_SCHEMA = """
    at timestamp_ntz, run_id string, table_run_id string, phase string, table_schema string, table_name string,
    error_type string, message string, context map<string,string>
"""
CYCLIC_REASON = "not run: the table is on a dependency cycle"
BELOW_CYCLE_REASON = "not run: the table depends on a dependency cycle"


class MigrationFailed(RuntimeError):
    def __init__(self, message: str, trace: DataFrame):
        super().__init__(message)
        self.trace = trace


def declared_foreign_keys(spark: SparkSession, loads: list[TableLoad]) -> DataFrame:
    """Foreign-key rows between sources, as the target schemas of the contract declare them."""
    source_of = {load.target.id: load.source for load in loads}
    rows = [
        (source_of[fk.parent].schema, source_of[fk.parent].table, load.source.schema, load.source.table)
        for load in loads for fk in load.schema.foreign_keys if fk.parent in source_of
    ]
    return spark.createDataFrame(rows, FK_SCHEMA)


@dataclass
class Plan:
    levels: dict[str, int]  # executable tables and the level they load at
    cyclic: list[str]
    blocked: list[str]
    parents: dict[str, list[str]]


def plan_loads(spark: SparkSession, loads: list[TableLoad], fk_rows: DataFrame) -> Plan:
    """Load order of the tables of one contract.

    The foreign-key catalog is searched by a job.  What comes back are edges
    between the tables the caller listed, few enough to walk here; for graphs
    that are data themselves see `operators.graph.load_plan`.
    """
    mapping = spark.createDataFrame(
        [(i, load.source.id, load.key) for i, load in enumerate(loads)],
        "ordinal int, source_id string, contract_key string",
    )
    edges = map_edges(included_edges(fk_rows, mapping.select("source_id")), mapping)
    pairs = sorted({(row["parent"], row["child"]) for row in edges.where("parent <> child").collect()})
    parents: dict[str, list[str]] = {load.entry: [] for load in loads}
    for parent, child in pairs:
        parents[child].append(parent)
    levels: dict[str, int] = {}
    while free := [n for n in parents if n not in levels and all(p in levels for p in parents[n])]:
        levels |= {n: max((levels[p] + 1 for p in parents[n]), default=0) for n in free}
    stuck = sorted(set(parents) - set(levels))
    inside = [pair for pair in pairs if pair[1] in stuck and pair[0] in stuck]
    cyclic = _on_a_cycle(inside)
    return Plan(levels, cyclic, [n for n in stuck if n not in cyclic], parents)


def _on_a_cycle(pairs: list[tuple[str, str]]) -> list[str]:
    """Few edges, at hand already: walked here."""
    edges = pa.table({"parent": pa.array([p for p, _ in pairs], pa.string()), "child": pa.array([c for _, c in pairs], pa.string())})
    return sorted(on_cycles(edges)["id"].to_pylist())


def _ways(plan: Plan) -> dict[str, int]:
    """Tables on the longest way from each executable table down to one that nothing depends on."""
    longest = dict.fromkeys(plan.levels, 1)
    for name in sorted(plan.levels, key=plan.levels.__getitem__, reverse=True):
        for parent in plan.parents[name]:
            if parent in longest:
                longest[parent] = max(longest[parent], longest[name] + 1)
    return longest


def run_by_edges(plan: Plan, targets: dict[str, str], run: Callable[[str], dict], concurrency: int) -> list[dict]:
    """`run` every executable table as soon as its own parents have ended; what it returned, in the order of the ends.

    Of those that may start the one with the longest way below it goes first.  Entries
    with one target (`targets`) follow each other in the order of the plan.  An
    error of `run` itself ends the run once the tables under way have ended.
    """
    order = sorted(plan.levels, key=lambda name: (plan.levels[name], name))
    waits = {name: set(plan.parents[name]) for name in order}
    last: dict[str, str] = {}
    for name in order:
        if targets[name] in last:
            waits[name].add(last[targets[name]])
        last[targets[name]] = name
    longest, ended, running, results = _ways(plan), set(), {}, []
    with ThreadPoolExecutor(concurrency) as pool:
        while len(results) < len(order):
            ready = sorted((n for n in order if n not in ended and n not in running.values() and waits[n] <= ended),
                           key=lambda n: (-longest[n], order.index(n)))
            for name in ready[: concurrency - len(running)]:
                future: Future = pool.submit(run, name)
                running[future] = name
            for future in wait(running, return_when=FIRST_COMPLETED).done:
                results.append(future.result())
                ended.add(running.pop(future))
    return results


def schema_violations(spark: SparkSession, loads: list[TableLoad], sources: dict[str, TargetSchema]) -> dict[str, str]:
    """What the declared source schemas (by contract key) break in their targets', by entry; all tables in one comparison."""
    compared = [load for load in loads if load.key in sources]
    if not compared:
        return {}
    # the entry stands for the table on both sides: two entries may share a source or a target
    mapping = spark.createDataFrame(
        [(i, load.entry, load.entry, load.target.schema, load.target.table) for i, load in enumerate(compared)],
        "ordinal int, source_id string, target_id string, target_schema string, target_table string")
    own = {load.target.id: load.entry for load in compared}

    def catalog(schemas: dict[str, TargetSchema]) -> dict[str, DataFrame]:
        return declared_catalog(spark, {
            entry: replace(s, foreign_keys=[replace(fk, parent=own.get(fk.parent, fk.parent)) for fk in s.foreign_keys])
            for entry, s in schemas.items()})

    source = catalog({load.entry: sources[load.key] for load in compared})
    target = catalog({load.entry: load.schema for load in compared})
    keys = {"foreign_keys": source["foreign_keys"].limit(0)}  # parents are compared by the load order, not here
    found = schema_diff(mapping, source | keys, target).select("target_id", F.concat_ws(" ", "rule", "column_name").alias("rule"))
    rows = found.groupBy("target_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("rules")).collect()
    return {r["target_id"]: r["rules"] for r in rows}


def migrate(spark: SparkSession, loads: list[TableLoad], sources: dict[str, DataFrame],
            targets: dict[str, VersionedTable], run_id: str, folder: str, fk_rows: DataFrame | None = None,
            strict: bool = True, concurrency: int = 4, source_schemas: dict[str, TargetSchema] | None = None) -> DataFrame:
    """Run the enabled loads and return their trace, one row per table.

    `sources` and `targets` go by contract key.  `folder` takes state, traces,
    errors and rejects; a table's trace is written when the table ends.  A table starts
    when its own parents have ended, whatever else is still running; those with the same target go one after the other.
    Declared schemas of the sources are compared with the targets' first; a table
    that breaks a rule is not run.  With `strict` the run fails if more tables
    failed or were blocked than cycles made unavoidable.
    """
    loads = validate(loads)
    by_id = {load.entry: load for load in loads}
    plan = plan_loads(spark, loads, fk_rows if fk_rows is not None else declared_foreign_keys(spark, loads))
    broken = schema_violations(spark, loads, source_schemas or {})
    stopped: set[str] = set()
    numbers = {name: i for i, name in enumerate(sorted(plan.levels, key=lambda n: (plan.levels[n], n)), 1)}

    def run(name: str) -> dict:
        load, number = by_id[name], numbers[name]
        blockers = [p for p in plan.parents[name] if p in stopped]
        if blockers:
            trace = _trace(load, run_id, number, BLOCKED, f"not run: parents failed: {', '.join(blockers)}")
        elif name in broken:
            trace = _trace(load, run_id, number, FAILED, f"not run: the schemas differ: {broken[name]}", "SCHEMA_MISMATCH")
        else:
            trace = _run_one(load, sources, targets, run_id, number, folder, [by_id[p] for p in plan.parents[name]])
        if trace["status"] != SUCCESS:
            stopped.add(name)
        trace["level"] = plan.levels[name]
        records.append(clerks.submit(record, trace))
        return trace

    def record(trace: dict) -> None:
        row = spark.createDataFrame([_trace_row(trace)], TRACE_SCHEMA).coalesce(1)
        write_table_trace(row, f"{folder}/traces", run_id, trace["load"].entry)

    records: list[Future] = []
    with ThreadPoolExecutor(concurrency) as clerks:  # no table waits for another one's trace
        try:
            ran = run_by_edges(plan, {name: by_id[name].target.id for name in plan.levels}, run, concurrency)
            traces = sorted(ran, key=lambda t: t["load_order"])
            for stuck, status, reason in ((plan.cyclic, FAILED, CYCLIC_REASON), (plan.blocked, BLOCKED, BELOW_CYCLE_REASON)):
                for name in stuck:
                    traces.append(_trace(by_id[name], run_id, len(traces) + 1, status, reason, status))
                    records.append(clerks.submit(record, traces[-1]))
        finally:
            for written in records:
                written.result()
    _record_errors(spark, traces, folder)
    for log in ("state", "errors"):  # one file for each table's entry would pile up over the runs
        roll_log(spark, f"{folder}/{log}")
    written = read_trace(spark, f"{folder}/traces").where(F.col("run_id") == run_id)
    _verdict(traces, plan, strict, written)
    return written


def _run_one(load: TableLoad, sources: dict[str, DataFrame], targets: dict[str, VersionedTable], run_id: str, number: int,
             folder: str, above: list[TableLoad]) -> dict:
    started = datetime.now()
    rejects = f"{folder}/rejects/{load.target.id}/{run_id}"
    try:
        source, target = sources[load.key], targets[load.key]
        parents = {p.target.id: targets[p.key].read() for p in above}
        if load.is_incremental:
            result = incremental_load(load, source, target, run_id, f"{folder}/state", parents, rejects)
        else:
            result = full_load(load, source, target, run_id, parents, rejects)
        trace = _trace(load, run_id, number, SUCCESS, None, result=result)
    except Exception as error:  # one table's failure never stops the others
        result = error.result if isinstance(error, LoadFailed) else None
        trace = _trace(load, run_id, number, FAILED, str(error), "EXECUTION_FAILED", result, type(error).__name__)
    return {**trace, "start_time": started, "end_time": datetime.now()}


def _trace(load: TableLoad, run_id: str, number: int, status: str, reason: str | None, outcome: str | None = None,
           result: LoadResult | None = None, error_type: str | None = None) -> dict:
    return {
        "load": load, "run_id": run_id, "load_order": number, "level": None, "status": status, "reason": reason,
        "outcome": outcome or status, "result": result or LoadResult(None), "error_type": error_type,
        "start_time": None, "end_time": None,
    }


def _trace_row(trace: dict) -> dict:
    load, result = trace["load"], trace["result"]
    start, end = trace["start_time"], trace["end_time"]
    failed = trace["status"] == FAILED
    spec = load.incremental if load.is_incremental else None
    return {
        "run_id": trace["run_id"], "table_run_id": f"{trace['run_id']}-{trace['load_order']:03d}",
        "table_id": load.target.id, "load_order": trace["load_order"], "level": trace["level"],
        "source": {"schema": load.source.schema, "name": load.source.table},
        "target": {"schema": load.target.schema, "name": load.target.table},
        "migration_type": load.migration_type, "status": trace["status"], "reason": trace["reason"],
        "records_processed": 0 if trace["status"] != SUCCESS else result.records_processed,
        "start_time": start, "end_time": end,
        "duration_ms": int((end - start).total_seconds() * 1000) if start else 0,
        "incremental": spec and {
            "column": spec.column, "previous_value": result.previous_value, "last_value": result.last_value,
            "state_updated": result.state_updated},
        "metrics": {
            "write_mode": result.write_mode, "source_selected": result.source_selected,
            "target_before": result.target_before, "target_after": result.target_after,
            "target_net_delta": result.target_net_delta,
            "consistency": result.consistency or trace["status"], "outcome": result.outcome or trace["outcome"],
            "warnings": [*result.warnings, *([trace["reason"]] if trace["reason"] else [])]},
        "errors": [trace["reason"]] if failed else [],
    }


def _record_errors(spark: SparkSession, traces: list[dict], folder: str) -> None:
    """Error records of loads that ran and failed; a planned stop by a cycle is none."""
    rows = [
        (t["end_time"], t["run_id"], f"{t['run_id']}-{t['load_order']:03d}", "TABLE_LOAD", t["load"].target.schema,
         t["load"].target.table, t["error_type"], t["reason"], None)
        for t in traces if t["error_type"]
    ]
    if rows:
        write_errors(spark.createDataFrame(rows, ERROR_SCHEMA), f"{folder}/errors")


def _verdict(traces: list[dict], plan: Plan, strict: bool, written: DataFrame) -> None:
    failed = sum(t["status"] == FAILED for t in traces)
    blocked = sum(t["status"] == BLOCKED for t in traces)
    if strict and (failed > len(plan.cyclic) or blocked > len(plan.blocked)):
        raise MigrationFailed(f"the run ended with {failed} failed and {blocked} blocked tables", written)
