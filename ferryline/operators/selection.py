"""Which rows a load takes: filter, cursor, batch, projection, target shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ferryline.functions.types import stored_type

DEFAULT_BATCH = 1000  # fixed value: rows per batch when none is given
TOP_K_ROWS = 10_000  # largest n for which one task may hold the n least values
SLICES = 1024  # slices of the cursor's range counted per pass
SKETCH_K = 4000  # size of the sketch of a cursor's values: about 60 KB, ranks right to 0.1 % of the rows in 99 cases of 100
RANK_BOUND = 0.004  # how far around the wanted rank values are counted, as a share of the rows


def where(df: DataFrame, predicate: str | None) -> DataFrame:
    """Rows that meet a SQL predicate; all rows without one."""
    return df.where(F.expr(predicate)) if predicate and predicate.strip() else df


def _literal(df: DataFrame, column: str, value) -> Column:
    """A cursor value travels as text and is compared in the column's own type."""
    return F.lit(str(value)).cast(df.schema[column].dataType)


def _text(value: Column, data_type: T.DataType) -> Column:
    """A cursor value as text.  An instant is written in UTC: local time repeats when clocks go back."""
    if not isinstance(data_type, T.TimestampType):
        return value.cast("string")
    seconds = (F.unix_micros(value).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.concat((epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).cast("string"), F.lit("Z"))


def last_cursor(df: DataFrame, column: str) -> str | None:
    """The greatest cursor value as text; None if there is none."""
    return df.agg(_text(F.max(column), df.schema[column].dataType)).first()[0]


def is_later(df: DataFrame, column: str, value: str, than: str) -> bool:
    """Whether one cursor value lies beyond another, in the column's own type."""
    later = _literal(df, column, value) > _literal(df, column, than)
    return bool(df.sparkSession.range(1).select(later).first()[0])


def after_cursor(df: DataFrame, column: str | None, start) -> DataFrame:
    """Rows strictly beyond `start`; a row without a cursor value never qualifies.

    The value is compared in the column's own type, so it prunes parquet row
    groups and can only ever be a value.
    """
    if not column or start is None:
        raise ValueError("an incremental load needs a cursor column and a start value")
    return df.where(F.col(column) > _literal(df, column, start))


def effective_start(specs: DataFrame, state: DataFrame, key: str = "state_key") -> DataFrame:
    """Per load: the saved cursor if there is one, else the configured start."""
    saved = state.select(key, "last_value")
    return specs.join(saved, key, "left").select(
        key,
        F.coalesce("last_value", "start_value").alias("effective_start"),
        F.col("last_value").isNotNull().alias("from_state"),
    )


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


# --- batches -----------------------------------------------------------------


def _require_batch(n: int) -> None:
    if n <= 0:
        raise ValueError("the batch size must be greater than 0")


def next_batch(df: DataFrame, cursor: str, start, n: int = DEFAULT_BATCH, predicate: str | None = None,
               tie_break: list[str] | None = None) -> DataFrame:
    """Exactly the next n rows by cursor, in no order; a tie at the cut is cut through, by `tie_break`.

    Everything below the n-th cursor value is a range filter and stays
    distributed; only of the rows tied at it a top-k takes what is still needed.
    """
    last = batch_end(df, cursor, start, n, predicate)
    selected = where(after_cursor(df, cursor, start), predicate)
    if last is None:
        return selected.limit(0)
    below = selected.where(F.col(cursor) < _literal(df, cursor, last))
    tied = selected.where(F.col(cursor) == _literal(df, cursor, last))
    if tie_break:
        tied = tied.orderBy(*tie_break)
    return below.union(tied.limit(n - below.count()))


def batch_end(df: DataFrame, cursor: str, start, n: int = DEFAULT_BATCH, predicate: str | None = None) -> str | None:
    """Cursor value that closes the next batch of at least n rows; None if it is empty."""
    _require_batch(n)
    return kth_cursor(where(after_cursor(df, cursor, start), predicate), cursor, n)


def next_batch_with_ties(df: DataFrame, cursor: str, start, n: int = DEFAULT_BATCH,
                         predicate: str | None = None) -> DataFrame:
    """The next n rows by cursor and all rows tied with the last of them.

    Only the closing value is searched for; the batch itself is a range filter
    and stays distributed whatever its size.
    """
    last = batch_end(df, cursor, start, n, predicate)
    selected = where(after_cursor(df, cursor, start), predicate)
    if last is None:
        return selected.limit(0)
    return selected.where(F.col(cursor) <= _literal(df, cursor, last))


def between_cursors(df: DataFrame, cursor: str, start, last) -> DataFrame:
    """Rows beyond `start` and up to `last`."""
    return after_cursor(df, cursor, start).where(F.col(cursor) <= _literal(df, cursor, last))


def stretches(ordered: DataFrame, cursor: str, rows: int) -> list[str]:
    """Cursor values that cut files dealt by ranges of the cursor into stretches of whole files, of about `rows` rows; the last closes the last stretch.

    A file that has more is a stretch of its own.  A row for each file reaches the driver.
    """
    data_type = ordered.schema[cursor].dataType
    files = ordered.select(cursor, "_metadata.file_path").groupBy("file_path").agg(F.max(cursor).alias("c"), F.count("*").alias("n"))
    ends, size = [], 0
    for last, n in files.orderBy("c").select(_text(F.col("c"), data_type), "n").collect():
        if ends and size + n <= rows:
            ends[-1] = last
        else:
            ends, size = [*ends, last], 0
        size += n
    return ends


def batch_ends(df: DataFrame, cursor: str, n: int) -> tuple[list[str], str | None]:
    """Cursor values that close the batches of at least n rows that rows are cut into, ties kept together, and that of the rows left over.

    One task walks over the different values and their counts, in order, and holds a batch of
    them at a time: for a bounded stretch of rows.
    """
    _require_batch(n)
    data_type = df.schema[cursor].dataType
    counts = df.where(F.col(cursor).isNotNull()).groupBy(F.col(cursor).alias("c")).agg(F.count("*").alias("n"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, last = 0, None
        for batch in batches:
            upto, cuts, closed = np.cumsum(batch.column("n").to_numpy()), [], 0
            while (at := int(np.searchsorted(upto, closed - left + n))) < len(upto):
                cuts, closed, left = [*cuts, at], int(upto[at]), 0
            if len(upto):
                left += int(upto[-1]) - closed
                last = batch.column("c").slice(len(upto) - 1) if left else None
                yield pa.RecordBatch.from_arrays([batch.column("c").take(pa.array(cuts, pa.int64())), pa.array([True] * len(cuts), pa.bool_())], names=["c", "full"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([last, pa.array([False])], names=["c", "full"])

    found = counts.repartition(1).sortWithinPartitions("c").mapInArrow(walk, f"c {data_type.simpleString()}, full boolean")
    ends = found.orderBy("c").select(_text(F.col("c"), data_type), "full").collect()
    return [end for end, full in ends if full], next((end for end, full in ends if not full), None)


def batch_number(df: DataFrame, cursor: str, ends: list[str]) -> Column:
    """Which of the batches closed by `ends` a row is in, from 0: a few comparisons a row."""
    if len(ends) <= 1:
        return F.lit(0)
    half = len(ends) // 2
    return F.when(F.col(cursor) <= _literal(df, cursor, ends[half - 1]), batch_number(df, cursor, ends[:half])).otherwise(
        batch_number(df, cursor, ends[half:]) + half)


def batch_cursor(batch: DataFrame, cursor: str) -> DataFrame:
    """Greatest cursor of a batch (null for an empty one) and its row count."""
    return batch.agg(F.max(cursor).alias("last_value"), F.count("*").alias("n_rows"))


def _position(column: Column, data_type: T.DataType) -> Column | None:
    """A number that grows with the column, or None where there is no such number."""
    if isinstance(data_type, T.NumericType):
        return column.cast("double")
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(data_type, T.TimestampNTZType):
        # Wall-clock parts: free of the session zone and its clock changes.
        return (
            F.unix_date(column.cast("date")).cast("double") * 86_400_000_000
            + F.hour(column) * 3_600_000_000.0
            + F.minute(column) * 60_000_000.0
            + F.date_part(F.lit("SECOND"), column).cast("double") * 1_000_000
        )
    return None


def kth_cursor(df: DataFrame, cursor: str, n: int) -> str | None:
    """n-th least cursor value as text, counting ties; the greatest if there are fewer rows."""
    values = df.select(F.col(cursor).alias("c")).where("c IS NOT NULL")
    if n <= TOP_K_ROWS:
        return _kth_of_few(values, n)
    if _position(F.col("c"), values.schema["c"].dataType) is None:
        return _kth_by_ranges(values, n)
    return _kth_by_sketch(values, n)


def _kth_of_few(values: DataFrame, n: int) -> str | None:
    return last_cursor(values.orderBy("c").limit(n), "c")


def _kth_by_sketch(values: DataFrame, n: int) -> str | None:
    """Two passes over the values whatever n is: a quantile sketch brackets the n-th, then what lies below is counted and what lies inside listed.

    The sketch is merged from the tasks' own.  The second pass writes a row per
    different value inside the bracket, and one for all below it; the n-th is then found
    among those.  Where the sketch was further off than its bound, which the
    counts show, the range is narrowed by slices instead.
    """
    data_type = values.schema["c"].dataType
    sketched = values.agg(F.kll_sketch_agg_double(_position(F.col("c"), data_type), F.lit(SKETCH_K)).alias("sketch"),
                          F.count("*").alias("total"), _text(F.max("c"), data_type).alias("greatest"))
    sketch, total, greatest = sketched.first()  # the sketch has a bounded size
    if total <= n:
        return greatest
    ranks = [n / total - RANK_BOUND, n / total + RANK_BOUND]
    bounds = [F.kll_sketch_get_quantile_double(F.lit(bytes(sketch)), F.lit(r)) if 0 < r < 1 else F.lit(None) for r in ranks]
    low, high = values.sparkSession.range(1).select(*[b.alias(f"bound_{i}") for i, b in enumerate(bounds)]).first()
    return _kth_in_bracket(values, n, low, high)


def _kth_in_bracket(values: DataFrame, n: int, low: float | None, high: float | None) -> str | None:
    """The n-th of more than n values, if its position lies between the bounds; otherwise by slices."""
    from ferryline.session import materialize

    position = _position(F.col("c"), values.schema["c"].dataType)
    upto = values if high is None else values.where(position <= high)
    named = F.col("c") if low is None else F.when(position >= low, F.col("c"))
    counts = materialize(upto.groupBy(named.alias("c")).agg(F.count("*").alias("n")), "cursor-bracket")
    below, inside = counts.agg(F.sum(F.when(F.col("c").isNull(), F.col("n"))), F.sum(F.when(F.col("c").isNotNull(), F.col("n")))).first()
    left = n - (below or 0)
    if not 0 < left <= (inside or 0):
        return _kth_by_slices(values, n)
    return _kth_of_counts(counts.where("c IS NOT NULL"), left)


def _kth_by_slices(values: DataFrame, n: int) -> str | None:
    """Narrow the range around the n-th value by counting equal slices of it.

    Each pass returns at most SLICES + 1 rows; after the first, min/max pruning
    leaves little to read.
    """
    data_type = values.schema["c"].dataType
    ends = [_text(F.min("c"), data_type).alias("least"), _text(F.max("c"), data_type).alias("greatest")]
    least, greatest, total = values.agg(*ends, F.count("*")).first()
    if total <= n:
        return greatest
    left = n
    while True:
        if least == greatest:
            return least
        first, last = _literal(values, "c", least), _literal(values, "c", greatest)
        inside = values.where(F.col("c").between(first, last))
        if total <= TOP_K_ROWS:
            return _kth_of_few(inside, left)
        low = _position(first, data_type)
        span = _position(last, data_type) - low
        share = F.coalesce(F.try_divide(_position(F.col("c"), data_type) - low, span), F.lit(0.0))
        slices = (
            inside.groupBy(F.floor(share * SLICES).alias("slice"))
            .agg(F.count("*").alias("n"), *ends)
            .orderBy("slice")
            .collect()
        )
        for one in slices:
            if one["n"] >= left:
                break
            left -= one["n"]
        if len(slices) == 1:  # values too close for a double to tell apart
            return _kth_by_ranges(inside, left)
        least, greatest, total = one["least"], one["greatest"], one["n"]


def _kth_by_ranges(values: DataFrame, n: int) -> str | None:
    """The same for values without a numeric position: count per range partition."""
    return _kth_of_counts(values.groupBy("c").agg(F.count("*").alias("n")), n)


def _kth_of_counts(counted: DataFrame, n: int) -> str | None:
    """n-th least of values that come with their counts (c, n)."""
    from ferryline.session import materialize

    spread = counted.repartitionByRange("c")
    counts = materialize(spread.withColumn("part", F.spark_partition_id()), "cursor-counts")
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"), F.min("c").alias("least"), F.max("c").alias("greatest"))
    data_type = counted.schema["c"].dataType
    parts = parts.withColumn("last_value", _text(F.col("greatest"), data_type))
    left = n
    chosen = None
    for chosen in parts.orderBy("least").collect():
        if chosen["n"] >= left:
            break
        left -= chosen["n"]
    else:
        return chosen["last_value"] if chosen else None
    running = F.sum("n").over(W.partitionBy("part").orderBy("c"))
    inside = counts.where(F.col("part") == chosen["part"]).select("c", running.alias("upto"))
    return inside.where(F.col("upto") >= left).agg(_text(F.min("c"), data_type)).first()[0]


# --- shape -------------------------------------------------------------------


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """`df` in the columns, order and types of the target.

    Columns match without regard to case.  A column only the target has takes
    its default; one only the source has is an error.  A value that cannot be
    cast becomes null (see `operators.rows` for reporting those).
    """
    have = {name.lower(): name for name in df.columns}
    extra = sorted(set(have) - {field.name.lower() for field in schema})
    if extra:
        raise ValueError(f"columns missing in the target: {', '.join(extra)}")
    defaults = {name.lower(): value for name, value in (defaults or {}).items()}
    return df.select(*[_conformed(df, field, have, defaults) for field in schema])


def _conformed(df: DataFrame, field: T.StructField, have: dict, defaults: dict) -> Column:
    target_type = stored_type(field.dataType)
    source = have.get(field.name.lower())
    if source is None:
        return F.lit(defaults.get(field.name.lower())).cast(target_type).alias(field.name)
    if df.schema[source].dataType == target_type:
        return F.col(source).alias(field.name)
    return F.col(source).try_cast(target_type).alias(field.name)
