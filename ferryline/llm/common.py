"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.session import materialize

# A word is a run of anything but the ASCII blanks; bytes.split() cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
# A run of ASCII letters and digits and of anything beyond ASCII, in a text whose A-Z are lower-cased.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Words of a text; null has none."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task holds few texts as Python strings."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 512) -> DataFrame:
    """`fn` turns a batch into columns by name; nothing is kept between batches."""
    def run(batches):
        for batch in slices(batches, rows):
            columns = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values()],
                                             names=list(columns))

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def numbered(df: DataFrame, label: str, *order) -> DataFrame:
    """`df` with `position`, its place from 0 in the given order.

    A distributed sort, written once with each row's place in its partition;
    only one count per partition reaches the driver.
    """
    part = F.shiftright("spot", 33)
    rows = materialize(df.orderBy(*order).withColumn("spot", F.monotonically_increasing_id()), label)
    offsets, total = {}, 0
    for p, n in sorted(rows.groupBy(part.alias("p")).count().collect()):
        offsets[p], total = total, total + n
    spark = df.sparkSession
    starts = spark.createDataFrame([(p, n) for p, n in offsets.items()], "p long, before long")
    joined = rows.join(F.broadcast(starts), part == F.col("p"))  # a row per partition of the sort
    return joined.select(*df.columns, (F.col("before") + F.col("spot").bitwiseAND((1 << 33) - 1)).alias("position"))
