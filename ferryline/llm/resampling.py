"""Resampling documents towards a target's distribution of word n-grams.

Every run of 1 to `n` words is a feature, hashed to a bucket.  Where a bucket has
a greater share of the target's features than of the documents', it gains; a
document weighs the mean gain of its features.  Random noise of the Gumbel
distribution, seeded by the id, turns the highest sums of weight and noise into a
draw without replacement.

A batch goes through Arrow kernels: its texts are lower-cased, split and flattened
to one array of words, whose dictionary is hashed once.  Shifted dictionary
numbers form n-grams, each distinct one is hashed by carrying the checksum of the
words before it on, and gains are taken and summed by segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import numbered
from ferryline.session import materialize

BUCKETS = 10_000
NGRAM = 1
LEAST_WORDS = 20  # words of a document that may be drawn
PERCENT = 10  # of those documents that are drawn
SEED = "2024"
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what parts words, in lower case
BATCH_BYTES = 4 << 20  # of the texts taken at once; a longer text goes alone


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose texts, the last column, take about `BATCH_BYTES`."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.columns[-1]).fill_null(0).to_numpy(), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + BATCH_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts as dictionary array, and how many each text has."""
    cut = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), APART)
    words = pc.list_flatten(cut)
    owner = pc.list_parent_indices(cut).to_numpy()
    real = pc.not_equal(words, "")  # before a leading mark and behind a closing one
    sizes = np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return words.filter(real).dictionary_encode(), sizes


def bucketed(texts: pa.Array, ngram: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, features of each text, words of each text); the features of one text stand together."""
    words, sizes = _words(texts)
    kinds = [w.encode() for w in words.dictionary.to_pylist()]
    number = words.indices.to_numpy().astype(np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)  # of the text a word is in
    at = np.arange(len(number))
    gram, sums = number, np.array([zlib.crc32(w) for w in kinds], np.uint32)  # of the grams of so many words
    parts, places = [sums[gram] % np.uint32(buckets)], [at]
    for n in range(2, ngram + 1):
        at = at[at + n - 1 < ends[at]]
        pairs, gram_of = np.unique(gram[at] * len(kinds) + number[at + n - 1], return_inverse=True)
        heads, tails = (x.tolist() for x in np.divmod(pairs, len(kinds) or 1))
        sums = np.array([zlib.crc32(b" " + kinds[w], int(sums[h])) for h, w in zip(heads, tails)], np.uint32)
        gram = np.zeros(len(number), np.int64)
        gram[at] = gram_of
        parts.append(sums[gram_of] % np.uint32(buckets))
        places.append(at)
    place = np.concatenate(places)
    features = np.bincount(np.searchsorted(np.cumsum(sizes), place, "right"), minlength=len(sizes))
    return np.concatenate(parts)[np.argsort(place, kind="stable")].astype(np.int64), features, sizes


def bucket_counts(rows: DataFrame, text: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket, buckets that hold none left out; a task sends each bucket once."""
    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in _portions(batches):
            counts += np.bincount(bucketed(batch.columns[-1], ngram, buckets)[0], minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    parts = rows.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain), a row for each bucket: floor(1000 ln(share of the target / share of the documents)), both smoothed by one."""
    spark = docs.sparkSession
    held = bucket_counts(docs, "text", ngram, buckets).withColumn("in_target", F.lit(0).cast("long")).union(
        bucket_counts(target, "text", ngram, buckets).selectExpr("bucket", "0L AS n", "n AS in_target")).union(
        spark.range(buckets).selectExpr("id", "0L", "0L"))
    each = held.groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("in_target").alias("t"))
    sums = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    return each.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gains: np.ndarray, ngram: int = NGRAM) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row; weight is the floored mean gain, 0 without features."""
    def run(batches):
        for batch in _portions(batches):
            found, features, words = bucketed(batch.columns[-1], ngram, len(gains))
            upto = np.concatenate([[0], np.cumsum(gains[found])])
            ends = np.cumsum(features)
            sums = upto[ends] - upto[ends - features]
            columns = [batch.columns[0], *map(pa.array, (words, features, sums // np.maximum(features, 1)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS,
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of `docs` (doc_id, text) against `target` (text).

    Counts are over all texts of both tables.  Of the rows with `least_words` words
    or more `percent` in a hundred, rounded down, are drawn: those of highest score,
    ties to the smaller doc_id; rank counts them from 1 and is null for the rest.
    A null text has no words.  A null doc_id is hashed as an empty one and comes
    last among ties.  Repeated rows are rows of their own; rows of equal score and
    doc_id rank by n_features, others of those in no order that shows.  An empty target or
    table of documents gives weights that only smoothing decides, or no rows.
    Extra columns of either table are ignored.

    Only the gains, one number per bucket, pass through the driver.
    """
    table = np.zeros(buckets, np.int64)
    for bucket, gain in bucket_gains(docs, target, ngram, buckets).collect():
        table[bucket] = gain
    word = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(word, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = materialize(weigh(docs, table, ngram), "weights").withColumn("score", F.col("weight") + noise)
    order = [~F.col("_may"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features"]
    placed = numbered(scored.withColumn("_may", F.col("n_words") >= least_words), "resampled", *order)
    drawn = placed.agg(F.count_if("_may")).first()[0] * percent // 100
    return placed.select("doc_id", "n_words", "n_features", "weight", "score",
                         F.when(F.col("position") < drawn, F.col("position") + 1).alias("rank"))
