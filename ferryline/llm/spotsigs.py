"""SpotSigs fingerprints: signatures made of common words and the content words that follow.

Common words (anchors) are spread over running text but rare in menus and lists;
each run of them, with the chain of content words behind it, is a signature.  A
document's fingerprint is the set of its signatures, and two fingerprints are as
like as their Jaccard similarity.  All of it is built-in functions on one row:
anchors are tied to the word behind them with a mark, so that splitting at
blanks gives one token per content word, and a signature is a marked token with
the content words after it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.llm.components import components
from ferryline.session import materialize

# Common words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to
was we were which who will with you
au aux ce dans de des du elle en est et il la le les mais ne nous on ou par pas pour que qui se son sur un une
als am auf aus bei das dem den der des die ein eine er es für ich im in ist mit nicht sich sie so und von war wie zu
como con de del el en es esta la las lo los más no para pero por que se si su sus un una y
""".split()
CHAIN = 3  # content words of a signature
MARK = "\u0001"
SIMILAR = 0.8
BUCKET_ROWS = 1_000
MOST_BUCKETS = 1 << 16


def _tree_pattern(words: list[str]) -> str:
    """A pattern for any of the words that tries each first letter once."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    branches = [head + _tree_pattern(tails) for head, tails in heads.items()]
    if not branches:
        return ""
    pattern = branches[0] if len(branches) == 1 and "" not in words else f"(?:{'|'.join(branches)})"
    return pattern + "?" if "" in words else pattern


_ANCHOR = f"(?<![^ ])({_tree_pattern(ANCHORS)}) "


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with the sorted distinct signature hashes of a text (not null) as array<int> `name`.

    Blanks and signs separate words, case doesn't count.  Chains at the end of a
    text are shorter.  A text without anchors has one signature, the text itself.
    """
    plain = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " ")
    tied = F.regexp_replace(F.concat(plain, F.lit(" ")), _ANCHOR, f"$1{MARK}")
    # a column of its own: the lambda below reads it at several places
    cut = df.withColumn("_tokens", F.split(tied, " +"))
    tokens = F.col("_tokens")

    def content(i):
        return F.substring_index(F.get(tokens, i), MARK, -1)

    spots = F.transform(tokens, lambda t, i: F.when(
        F.contains(t, F.lit(MARK)), F.hash(t, *[content(i + k) for k in range(1, CHAIN)])))
    found = F.sort_array(F.array_distinct(F.array_compact(spots)))
    cut = cut.withColumn("_found", found)
    return cut.withColumn(name, F.when(F.size("_found") > 0, F.col("_found")).otherwise(
        F.array(F.hash(F.lit("text"), F.col(text))))).drop("_tokens", "_found")


def fingerprint(signatures: str) -> Column:
    """The set as text: eight hex digits for each signature."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets that aren't empty."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def ranges(docs: DataFrame) -> tuple[Column, list[int]]:
    """A bucket number for each doc_id, -1 for null, rising with doc_id, and the buckets' bounds (`MOST_BUCKETS` at most)."""
    rows = docs.where("doc_id IS NOT NULL").count()
    n = min(MOST_BUCKETS, max(1, rows // BUCKET_ROWS))
    bounds = []
    if n > 1:
        shares = F.array(*[F.lit(i / n) for i in range(1, n)])
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10 * n)).first()[0]))
    doc_id = F.col("doc_id")
    if not bounds:
        return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.lit(0)), bounds
    step = math.isqrt(len(bounds)) + 1
    runs = [bounds[at : at + step] for at in range(0, len(bounds), step)]
    firsts = F.array(*[F.lit(r[0]).cast("long") for r in runs])
    run = F.size(F.filter(firsts, lambda x: x <= doc_id))  # two short searches in place of a long one
    inner = F.get(F.array(*[F.array(*[F.lit(x).cast("long") for x in r]) for r in runs]), run - 1)
    within = F.when(run == 0, F.lit(0)).otherwise((run - 1) * step + F.size(F.filter(inner, lambda x: x <= doc_id)))
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(within), bounds


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`docs` with the `columns` of the next row in descending doc_id, as next_*; the last row's next is the first.

    Rows are dealt into ranges of doc_id in one shuffle; each range also gets the
    first row of the one after it, so that no range is looked at twice.  Null
    doc_ids come last; rows with equal ids go by a hash of the text.
    """
    spark = docs.sparkSession
    bucket, _ = ranges(docs.select("doc_id"))
    heads = sorted(docs.select("doc_id", bucket.alias("b")).groupBy("b").agg(F.max("doc_id").alias("id")).collect(), reverse=True)
    after = [(h["b"], h["id"], heads[i - 1]["b"]) for i, h in enumerate(heads)]  # the first row goes after the last
    firsts = spark.createDataFrame(after, "b int, head long, also int")
    placed = docs.withColumn("_b", bucket).join(
        F.broadcast(firsts), (F.col("_b") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    spots = F.array_compact(F.array(F.struct(F.col("_b").alias("at"), F.lit(0).alias("copy")),
                                    F.when(F.col("also").isNotNull(), F.struct(F.col("also").alias("at"), F.lit(1).alias("copy")))))
    dealt = placed.withColumn("_spot", F.explode(spots)).select(*docs.columns, "_spot.at", "_spot.copy")
    window = Window.partitionBy("at").orderBy("copy", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    ahead = dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return ahead.where("copy = 0").drop("at", "copy")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts of `docs` (doc_id, text) and of their edited texts.

    The edited text has its last half (rounded down, in code points) replaced by
    as much of the beginning of the next text in descending doc_id, or all of it.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  A null text is an empty one; equal texts, empty ones
    too, have equal fingerprints and likeness 1.  Rows of one doc_id, and those
    without one, have a row each and follow one another; other columns are
    ignored; an empty table gives an empty one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = with_next(with_signatures(texts, "text", "own"), ["text", "own"])
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = signed.withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    both = with_signatures(edited, "edited", "changed")
    return both.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint("own").alias("fingerprint"), fingerprint("changed").alias("edited_fingerprint"),
                       likeness("own", "changed").alias("near_edited"), likeness("own", "next_own").alias("near_next"))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id) for each row of `docs` (doc_id, text): documents linked by a likeness of `similar` or more.

    Equal sets are one to begin with.  Sets are partitioned by length so that
    likeness can only reach `similar` within a partition or between neighbours;
    of each only its rarest signatures are looked up, as many as guarantee that
    two like sets share one, and a pair whose lengths differ too much is pruned
    before its Jaccard is computed.  class_id is the smallest doc_id reachable.
    Null texts count as empty.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets = materialize(with_signatures(texts, "text", "own").select("doc_id", "own", F.xxhash64("own").alias("key")), "signature-sets")
    distinct = sets.groupBy("key").agg(F.first("own").alias("own"), F.min("doc_id").alias("first_id"))
    tokens = distinct.select("key", F.explode("own").alias("token"))
    rarity = tokens.groupBy("token").agg(F.count("*").alias("n"))
    ordered = tokens.join(rarity, "token").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"))
    size = F.size("ranked")
    length = F.floor(F.log(size.cast("double")) / F.lit(math.log(1 / similar))).cast("int")
    kept = (size - F.ceil(size * F.lit(similar) - 1e-9) + 1).cast("int")
    ranked = materialize(ordered.select("key", F.col("ranked.token").alias("own"), size.alias("size"), length.alias("length"),
                                        F.slice("ranked.token", F.lit(1), kept).alias("probe")), "ranked-sets")
    probes = ranked.select("key", "size", "length", F.explode("probe").alias("token"))
    left, right = probes.alias("l"), probes.alias("r")
    reach = right.select(F.col("key").alias("other"), F.col("size").alias("other_size"), "token",
                         F.explode(F.array(F.col("length"), F.col("length") + 1)).alias("length"))
    fits = F.least("size", "other_size") >= F.greatest("size", "other_size") * F.lit(similar) - 1e-9
    pairs = left.join(reach, ["token", "length"]).where((F.col("key") != F.col("other")) & fits).select("key", "other").distinct()
    a, b = ranked.select("key", "own"), ranked.select(F.col("key").alias("other"), F.col("own").alias("theirs"))
    links = pairs.join(a, "key").join(b, "other").where(likeness("own", "theirs") >= similar).select(
        F.col("key").alias("a"), F.col("other").alias("b"))
    roots = components(links)
    linked = roots.join(distinct.select("key", "first_id"), F.col("node") == F.col("key"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    labels = distinct.join(linked.join(least, "root").select("key", "least_id"), "key", "left").select(
        "key", F.coalesce("least_id", "first_id").alias("class_id"))
    return sets.select("doc_id", "key").join(labels, "key").select("doc_id", "class_id")
