"""Rows that two tables don't share, found by digests of ranges of a cursor.

A range's digest is its number of keys and two sums that don't depend on their
order.  Ranges that agree are done with; those that differ are cut into finer
ones, and only the rows of the finest that differ are joined.  So what moves
grows with the differences, not with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.operators.merge import no_null_key, without
from ferryline.operators.selection import _literal, _position, _text
from ferryline.session import materialize

SLOT = "_slot"
DIGEST = ["n", "mixed", "summed"]


def _in_slots(rows: DataFrame, cursor: str, width: float) -> DataFrame:
    """Rows with the number of their range; those whose cursor is no finite number share one of their own (null)."""
    place = _position(F.col(cursor), rows.schema[cursor].dataType)
    if place is None:
        raise ValueError(f"ranges need a cursor of numbers, dates or instants, not {cursor}")
    return rows.withColumn(SLOT, F.floor(place / F.lit(float(width))).try_cast("bigint"))


def range_digests(rows: DataFrame, cursor: str, keys: list[str], width: float) -> DataFrame:
    """(slot, n, mixed, summed, first, last) for each range of `width` that holds a row with its keys set.

    Ranges lie at multiples of `width` (days for a date, microseconds for an instant, else in the
    column's own unit), so digests kept from earlier stay comparable.  Rows are
    reduced to one per range in each task before anything moves, and only the
    cursor and the keys are read.
    """
    hashed = F.xxhash64(*keys)
    placed = _in_slots(rows.where(no_null_key(keys)).select(cursor, *keys), cursor, width)
    return placed.groupBy(SLOT).agg(
        F.count("*").alias("n"), F.bit_xor(hashed).alias("mixed"), F.sum(hashed.cast("decimal(20,0)")).alias("summed"),
        F.min(cursor).alias("first"), F.max(cursor).alias("last"))


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(slot, first, last) of the left digests that have no equal on the right."""
    other = right.select(SLOT, *[F.col(c).alias(f"_{c}") for c in DIGEST]).withColumnRenamed(SLOT, "_other")
    alike = F.col(SLOT).eqNullSafe(F.col("_other"))
    for c in DIGEST:
        alike = alike & (F.col(c) == F.col(f"_{c}"))
    return left.join(other, alike, "left_anti").select(SLOT, "first", "last")


def _inside(rows: DataFrame, cursor: str, width: float, slots: DataFrame, bounds: tuple[str, str]) -> DataFrame:
    """The rows of some ranges; the outermost bounds go to the scan as a filter."""
    low, high = (_literal(rows, cursor, bound) for bound in bounds)
    placed = _in_slots(rows.where(F.col(cursor).between(low, high)), cursor, width)
    wanted = slots.select(F.col(SLOT).alias("_wanted"))
    return placed.join(wanted, F.col(SLOT).eqNullSafe(F.col("_wanted")), "left_semi").drop(SLOT)


def missing_by_digest(source: DataFrame, compared: DataFrame, target: DataFrame, cursor: str, keys: list[str],
                      widths: list[float], kept: DataFrame | None = None) -> DataFrame:
    """Source rows whose keys the target does not have: the rows of `without(source, target, keys)`.

    `compared` is the part of the target that is expected to hold what the source does.
    `widths` are those of the ranges, from wide to fine.  `kept` are digests of that part
    at the widest, written at an earlier time: where the source still agrees with
    them the target is not opened.  They may be older than the target, if no
    row left it since: then more ranges are looked into.

    A row with a NULL in its keys is always missing; repeated rows come back each.  A source row
    without a cursor value, or whose key lies in the target under another one, is
    found as well: what the finest ranges leave is looked up in the whole target.
    """
    if source.schema[cursor].dataType != target.schema[cursor].dataType:
        raise ValueError(f"the two sides of {cursor} must have one type")
    types = {k: target.schema[k].dataType for k in keys}
    typed = source.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in source.columns])
    lost, mine, theirs = source.where(~no_null_key(keys)), typed, compared
    for level, width in enumerate(widths):
        own = range_digests(mine, cursor, keys, width)
        other = kept if level == 0 and kept is not None else range_digests(theirs, cursor, keys, width)
        slots = materialize(differing(own, other), "ranges")
        data_type = source.schema[cursor].dataType
        n, unplaced, low, high = slots.agg(F.count("*"), F.count_if(F.col(SLOT).isNull()), _text(F.min("first"), data_type),
                                           _text(F.max("last"), data_type)).first()
        if not n:
            return lost
        if unplaced:  # no bounds hold these rows: the ranges found so far are joined as they are
            break
        mine = _inside(mine, cursor, width, slots, (low, high))
        theirs = _inside(theirs, cursor, width, slots, (low, high))
    found = materialize(without(mine.where(no_null_key(keys)), theirs, keys), "candidates")
    # a key may lie in the target under another cursor: only the candidates' keys are looked up, whatever its size
    stored = target.where(no_null_key(keys)).select(*keys).join(found.select(*keys).distinct(), keys, "left_semi")
    still = without(found, stored, keys)
    return still.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in source.schema]).union(lost)
