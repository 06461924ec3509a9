"""Mixing sources to target weights: repetition rates per source, whole copies and a seeded draw per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import numbered, word_count
from ferryline.session import materialize

EXACT = "decimal(38,0)"
SEED = 42


def targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(source, source_size, target) for each source of `sizes` (source, size).

    Sources in order (by code point, null last) get the weights in turn and share
    the sum of all sizes by weight.  A target above `cap` times its source's size
    stops there, and what is over is shared by weight among the rest until none
    is above: as the common level only rises, a source once stopped stays so, and
    each round needs two sums over the sources.  A source without words gets 0.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.array(*[F.lit(w) for w in weights])
    ranked = materialize(numbered(sums, "sources", F.asc_nulls_last("source")).select(
        "source", "source_size", weight[(F.col("position") % len(weights)).cast("int")].cast(EXACT).alias("weight")), "weights")
    most = F.lit(cap).cast(EXACT) * F.col("source_size").cast(EXACT)
    total = int(ranked.agg(F.sum(F.col("source_size").cast(EXACT))).first()[0] or 0)
    level = None  # words to share and weights that share them
    stopped = F.lit(False)
    while True:
        used, shares, n = ranked.agg(
            F.sum(F.when(stopped, most)), F.sum(F.when(~stopped, F.col("weight"))), F.sum(stopped.cast("int"))).first()
        found = (total - int(used or 0), int(shares or 0), int(n or 0))
        if found == level:
            break
        level = found
        stopped = F.col("weight").cast("double") * level[0] > F.lit(cap) * F.col("source_size").cast("double") * level[1]
    share = F.col("weight").cast("double") * float(level[0]) / float(max(level[1], 1))
    target = F.when(stopped | (F.col("source_size") == 0), most.cast("double")).otherwise(share)
    return ranked.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the document and the seed alone; rows without id draw by text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mixture(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = SEED) -> DataFrame:
    """`docs` (doc_id, text, source and any others) with size, source_size, target and copies.

    A source's rate is its target over its size; a document is taken floor(rate)
    times and once more if its draw is below the fraction.  Size counts words; a
    null text has none.  A null source is a source of its own, the last.  Repeated
    rows are sized and drawn each for itself (the same id draws the same).
    Columns of `docs` with the names of the new ones are replaced.  An empty table
    gives an empty one.
    """
    old = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    sized = docs.select(*old, word_count("text").alias("size"))
    goals = targets(sized.select("source", "size"), weights, cap)
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size"))
    drawn = F.col("draw") < rate - F.floor(rate)
    s, g = sized.withColumn("draw", draw(F.col("doc_id"), F.col("text"), seed)).alias("s"), goals.alias("g")
    joined = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", "g.source_size", "g.target")
    return joined.withColumn("copies", F.floor(rate) + drawn.cast("long")).drop("draw")


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as many times as its `copies` say."""
    again = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return mixed.withColumn("copy", again).drop("copy")
