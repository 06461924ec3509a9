"""What to load from where to where, and the rules such a contract must meet."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from ferryline.functions.ids import DEFAULT_SCHEMA
from ferryline.operators.reconcile import APPEND_STRATEGIES
from ferryline.operators.rows import TargetSchema

# What an identifier may look like and what may be chosen.
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
MIGRATION_TYPES = ["full", "incremental"]
LOAD_STRATEGIES = ["upsert", *APPEND_STRATEGIES]


def _blank(value: str | None) -> bool:
    return value is None or not value.strip()


@dataclass(frozen=True)
class TableRef:
    table: str
    schema: str | None = None

    @property
    def id(self) -> str:
        schema = DEFAULT_SCHEMA if _blank(self.schema) else self.schema
        return f"{schema.strip()}.{self.table.strip()}".lower()


@dataclass(frozen=True)
class Incremental:
    column: str | None = None
    start_value: str | None = None
    batch_size: int | None = None
    load_strategy: str | None = None
    keys: list[str] | None = None

    @property
    def appends(self) -> bool:
        return not _blank(self.load_strategy) and self.load_strategy.strip().lower() in APPEND_STRATEGIES


@dataclass(frozen=True)
class TableLoad:
    """One entry of a contract; an entry that is not enabled is off."""

    key: str
    source: TableRef
    target: TableRef
    schema: TargetSchema
    migration_type: str | None = "full"
    enabled: bool = False
    where: str | None = None
    incremental: Incremental | None = None
    order_by: list[str] | None = None
    snapshot: bool = False  # copy the selection before working on it: for databases and sources that change

    @property
    def entry(self) -> str:
        """The key as entries are told apart by: case and blanks around it don't count."""
        return self.key.strip().lower()

    @property
    def is_incremental(self) -> bool:
        return (self.migration_type or "full").strip().lower() == "incremental"


class InvalidContract(ValueError):
    pass


def _identifier(load: TableLoad, field: str, value: str | None) -> None:
    if not IDENTIFIER.fullmatch((value or "").strip()):
        raise InvalidContract(f"{load.key}: {field} is not a plain identifier: {value!r}")


def _check_incremental(load: TableLoad) -> None:
    spec = load.incremental
    if spec is None:
        raise InvalidContract(f"{load.key}: an incremental load needs its settings")
    if _blank(spec.column):
        raise InvalidContract(f"{load.key}: an incremental load needs a cursor column")
    _identifier(load, "cursor column", spec.column)
    if _blank(spec.start_value):
        raise InvalidContract(f"{load.key}: an incremental load needs a start value")
    if spec.batch_size is not None and spec.batch_size <= 0:
        raise InvalidContract(f"{load.key}: the batch size must be greater than 0")
    if not _blank(spec.load_strategy) and spec.load_strategy.strip().lower() not in LOAD_STRATEGIES:
        raise InvalidContract(f"{load.key}: load strategy must be one of {', '.join(LOAD_STRATEGIES)}")
    if spec.keys is not None:
        if not spec.keys:
            raise InvalidContract(f"{load.key}: the list of key columns is empty")
        for key in spec.keys:
            _identifier(load, "key column", key)


def validate(loads: list[TableLoad]) -> list[TableLoad]:
    """The enabled loads, or InvalidContract."""
    if not loads:
        raise InvalidContract("a contract needs at least one table")
    for load in loads:
        if _blank(load.key):
            raise InvalidContract("a table entry has no name")
    active = [load for load in loads if load.enabled]
    entries = [load.entry for load in active]
    if repeated := sorted({e for e in entries if entries.count(e) > 1}):
        raise InvalidContract(f"table entries repeat: {', '.join(repeated)}")
    for load in active:
        for side, ref in (("source", load.source), ("target", load.target)):
            _identifier(load, f"{side} table", ref.table)
            if not _blank(ref.schema):
                _identifier(load, f"{side} schema", ref.schema)
        if _blank(load.migration_type) or load.migration_type.strip().lower() not in MIGRATION_TYPES:
            raise InvalidContract(f"{load.key}: migration type must be one of {', '.join(MIGRATION_TYPES)}")
        if load.is_incremental:
            _check_incremental(load)
    if not active:
        raise InvalidContract("no table of the contract is enabled")
    return active


def columns(ddl: str) -> T.StructType:
    """Target columns from DDL such as `id int NOT NULL, name varchar(20)` (needs a session)."""
    return T.DataType.fromDDL(ddl)
