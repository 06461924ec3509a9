"""Table identifiers and elapsed time as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the schema a table without one belongs to.
DEFAULT_SCHEMA = "public"
CONTROL_CHARACTERS = "".join(chr(code) for code in range(0x21))


def strip(value: Column) -> Column:
    """Trim everything up to U+0020 at both ends, not only spaces."""
    return F.btrim(value, F.lit(CONTROL_CHARACTERS))


def normalize(value: Column) -> Column:
    return F.lower(strip(value))


def is_blank(value: Column) -> Column:
    return F.coalesce(strip(value) == "", F.lit(True))


def required(value: Column, message: str) -> Column:
    """`value`, or a failed query where it is blank."""
    return F.when(is_blank(value), F.raise_error(F.lit(message)).cast("string")).otherwise(value)


def normalize_id(value: Column) -> Column:
    return normalize(required(value, "a table identifier must not be blank"))


def table_id(schema: Column, table: Column) -> Column:
    """`schema.table`, lower case and trimmed; a blank schema means the default one."""
    schema_name = F.when(is_blank(schema), F.lit(DEFAULT_SCHEMA)).otherwise(normalize(schema))
    return F.concat_ws(".", schema_name, normalize_id(table))


def split_id(value: Column) -> Column:
    """`struct<schema, table>` of an identifier, cut at its first dot."""
    dot = F.instr(value, ".")
    malformed = is_blank(value) | (dot <= 1) | (dot == F.length(value))
    checked = F.when(
        F.coalesce(malformed, F.lit(True)),
        F.raise_error(F.concat(F.lit("not of the form schema.table: "), F.coalesce(value, F.lit("null")))).cast("string"),
    ).otherwise(value)
    return F.struct(
        normalize(F.substring_index(checked, ".", 1)).alias("schema"),
        normalize(F.substr(checked, dot + 1)).alias("table"),
    )


def qualified_name(schema: Column, table: Column) -> Column:
    """`schema.table`, the bare table without a schema, empty without a table."""
    return (
        F.when(is_blank(table), F.lit(""))
        .when(is_blank(schema), table)
        .otherwise(F.concat_ws(".", schema, table))
    )


def duration_ms(start: Column, end: Column) -> Column:
    """Elapsed milliseconds between two timestamps (or ISO texts)."""
    return F.timestamp_diff("MILLISECOND", start.cast("timestamp"), end.cast("timestamp"))
