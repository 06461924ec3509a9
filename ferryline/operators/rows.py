"""The target's column rules checked on the rows themselves."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.functions.types import stored_type

VIOLATIONS = "_violations"


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str  # target id of the parent table
    parent_column: str


@dataclass(frozen=True)
class TargetSchema:
    """Columns of a target table and the constraints it enforces."""

    columns: T.StructType
    primary_key: list[str] = field(default_factory=list)
    unique: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    defaults: dict = field(default_factory=dict)

    @property
    def stored(self) -> T.StructType:
        """The columns as a DataFrame holds them."""
        return T.StructType([T.StructField(f.name, stored_type(f.dataType), True) for f in self.columns])


def _violation(rule: str, column: str) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"))


def _rules(df: DataFrame, column: T.StructField, source: str | None, value: Column, required: bool) -> list[Column]:
    rules = []
    if source is not None and df.schema[source].dataType != stored_type(column.dataType):
        numbers = isinstance(df.schema[source].dataType, T.NumericType) and isinstance(column.dataType, T.NumericType)
        rule = "overflow" if numbers else "bad_cast"
        failed = F.col(f"`{source}`").isNotNull() & value.isNull()
        rules.append(F.when(failed, _violation(rule, column.name)))
    if required:
        missing = (F.col(f"`{source}`") if source is not None else value).isNull()
        rules.append(F.when(missing, _violation("not_null", column.name)))
    if isinstance(column.dataType, (T.VarcharType, T.CharType)):
        rules.append(F.when(F.length(value) > column.dataType.length, _violation("too_long", column.name)))
    return rules


def check_rows(df: DataFrame, target: TargetSchema) -> DataFrame:
    """`df` in the target's shape plus the list of rules each row breaks.

    One pass and no shuffle: NOT NULL, failed casts, numeric overflow and text
    longer than the column.
    """
    from ferryline.operators.selection import _conformed, conform

    conform(df, target.columns, target.defaults)  # raises on a column the target lacks
    have = {name.lower(): name for name in df.columns}
    defaults = {name.lower(): value for name, value in target.defaults.items()}
    rules: list[Column] = []
    shaped = []
    for column in target.columns:
        value = _conformed(df, column, have, defaults)
        shaped.append(value)
        required = not column.nullable or column.name in target.primary_key
        rules += _rules(df, column, have.get(column.name.lower()), value, required)
    none = F.lit(None).cast("array<struct<rule:string,column:string>>")
    found = F.filter(F.array(*rules), lambda rule: rule.isNotNull()) if rules else none
    return df.select(*shaped, found.alias(VIOLATIONS))


def is_rejected() -> Column:
    return F.coalesce(F.size(VIOLATIONS) > 0, F.lit(False))


def row_violations(df: DataFrame, target: TargetSchema, key: list[str]) -> DataFrame:
    """One row per broken rule: key, column, rule."""
    return (
        check_rows(df, target)
        .where(is_rejected())
        .select(*key, F.explode(VIOLATIONS).alias("v"))
        .select(*key, F.col("v.column").alias("column_name"), F.col("v.rule").alias("rule"))
    )


def split_rejects(df: DataFrame, target: TargetSchema) -> tuple[DataFrame, DataFrame]:
    """(rows that may be written, rows that break a rule with the rules they break)."""
    checked = check_rows(df, target)
    return checked.where(~is_rejected()).drop(VIOLATIONS), checked.where(is_rejected())
