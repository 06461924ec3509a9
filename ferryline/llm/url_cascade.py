"""URL filters by exact membership in a cascade of Bloom filters.

The corpus's complete key universe is known: every host suffix and path prefix
of its URLs that a rule could name.  The first filter holds the listed keys; the
unlisted keys that pass it by mistake go into the second, the listed keys that
pass the second by mistake into the third, and so on until a filter lets nothing
false through.  A key of the universe is listed if and only if the first filter
that doesn't know it is an even one (the second, fourth ...), so rows are judged
without a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMIT = 256 << 20  # bytes of all filters, which go to every executor


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; null or no `://`: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The keys a URL fits: its host's last labels and its path's first characters, of each shape, longest first.

    A shape is (labels of the host, characters of the path); only the shapes that
    listed keys have can matter.
    """
    labels = F.split(host, r"\.", -1)
    keys = [F.when((F.size(labels) >= n) & (F.char_length(path) >= m),
                   F.concat(F.array_join(F.slice(labels, F.size(labels) - n + 1, F.lit(n)), "."), F.substring(path, 1, m)))
            for n, m in shapes]
    return F.array_compact(F.array(*keys))


class Cascade:
    """Filters as bit arrays, with the hash functions each uses."""

    def __init__(self, levels: list[tuple[np.ndarray, int]]):
        self.levels = levels  # (bits as 64-bit words, hash functions)

    @staticmethod
    def spots(h1: np.ndarray, h2: np.ndarray, level: int, k: int, words: int) -> np.ndarray:
        """Bit positions of keys in a level; h1 and h2 are two independent hashes of the key."""
        step = (h2 | np.uint64(1)) + np.uint64(level) * (h1 | np.uint64(1))
        at = (h1 ^ (h2 << np.uint64(level % 63 + 1)))[:, None] + np.arange(1, k + 1, dtype=np.uint64)[None, :] * step[:, None]
        at ^= at >> np.uint64(33)
        at *= np.uint64(0xFF51AFD7ED558CCD)
        at ^= at >> np.uint64(29)
        return at % np.uint64(words * 64)

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        words, k = self.levels[level]
        at = self.spots(h1, h2, level, k, len(words))
        return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed."""
        out, open_ = np.full(len(h1), len(self.levels) % 2 == 1), np.arange(len(h1))
        for level in range(len(self.levels)):
            passed = self.passes(level, h1[open_], h2[open_])
            out[open_[~passed]] = level % 2 == 1
            open_ = open_[passed]
        return out

    def size(self) -> int:
        return sum(words.nbytes for words, _ in self.levels)


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit("second"))


def build(universe: DataFrame, listed: DataFrame) -> Cascade:
    """The cascade for `listed` (key) within `universe` (key), which may hold repeats; nulls are left out.

    Filters are filled by Spark, a word of 64 bits per row, and gathered once
    their size is known to be bounded (`LIMIT` for all of them).
    """
    spark = universe.sparkSession
    h1, h2 = _hashes(F.col("key"))
    in_list = listed.select("key").distinct().withColumn("listed", F.lit(True))
    keys = materialize(universe.select("key").where("key IS NOT NULL").distinct().join(in_list, "key", "left").select(
        h1.alias("h1"), h2.alias("h2"), F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    cascade = Cascade([])
    while True:
        level = len(cascade.levels)
        shared = spark.sparkContext.broadcast(cascade.levels)
        left = _survivors(keys, shared) if level else keys
        inside = F.col("listed") == F.lit(level % 2 == 0)
        n, others = left.agg(F.sum(inside.cast("long")), F.sum((~inside).cast("long"))).first()
        n, others = n or 0, others or 0
        if not n:
            if not level:  # nothing is listed: one empty filter lets nothing through
                cascade.levels.append((np.zeros(1, np.uint64), 1))
            return cascade
        rate = 0.5 if level else min(0.5, math.sqrt(0.5) * n / max(others, 1))
        k = max(1, round(-math.log2(rate)))
        words = max(1, math.ceil(n * k / math.log(2) / 64))
        if cascade.size() + words * 8 > LIMIT:
            raise ValueError(f"{n} keys need more than {LIMIT} bytes of filters; split the list by host")
        filled = _fill(left.where(inside), level, k, words)
        shared.destroy()  # the next level has a larger one
        cascade.levels.append((filled, k))


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2"))


def _survivors(keys: DataFrame, levels) -> DataFrame:
    """Keys that every filter so far lets through."""
    def run(batches):
        cascade = Cascade(levels.value)
        for batch in batches:
            for level in range(len(cascade.levels)):
                batch = batch.filter(pa.array(cascade.passes(level, *_pairs(batch))))
            yield batch

    return keys.mapInArrow(run, keys.schema)


def _fill(keys: DataFrame, level: int, k: int, words: int) -> np.ndarray:
    def run(batches):
        for batch in batches:
            at = np.unique(Cascade.spots(*_pairs(batch), level, k, words))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)),
                 pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    filled = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    return out


def tracked_hosts(pages: DataFrame, one_in: int = 3) -> DataFrame:
    """(host) of `pages` (url) of which at least one page in `one_in` is reached by a link that tracks its readers.

    Such a link has a parameter `ref` or one that begins with `utm_`.  Null URLs and those without
    a host count for none; repeated rows count each.
    """
    tracked = F.count_if(F.col("url").rlike("[?&](utm_|ref=)"))
    hosts = pages.select(host_of(F.col("url")).alias("host"), "url").where("host <> ''")
    return hosts.groupBy("host").agg(F.count("*").alias("n"), tracked.alias("tracked")).where(
        F.col("tracked") * one_in >= F.col("n")).select("host")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], blocked_hosts: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of `pages` (page_id, url).

    `rules` are (verdict, host, path).  A rule fits its host and all subdomains
    if the URL's path starts with the rule's; the longest (host and path
    together) wins.  A URL that none fits is blocked if its host or a parent
    domain is among `blocked_hosts` (host), else allowed; that list may be long,
    its nulls, empty hosts and repeats count for nothing and A-Z is lowered.  Two cascades over the
    corpus's keys tell which keys are rules and which are blocked.  A null URL,
    an empty one and one without `://` have an empty host and path.  Repeated rows
    are judged each for itself; other columns are ignored.
    """
    spark = pages.sparkSession
    # a host on its own ends in a mark that no host or path has, so that it can't be taken for a rule
    ruled = spark.createDataFrame([(host + path, verdict == "block") for verdict, host, path in rules], "key string, block boolean")
    blocked = blocked_hosts.select(F.translate("host", UPPER, LOWER).alias("host")).where("host <> ''").distinct()
    blocked = materialize(blocked, "blocked-hosts")
    shapes = sorted({(host.count(".") + 1, len(path)) for _, host, path in rules}, key=lambda s: (-s[1], -s[0]))
    depths = sorted(r[0] for r in blocked.select(F.size(F.split("host", r"\.", -1))).distinct().collect())  # a number for each depth of names
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = keys_of(F.col("host"), F.col("path"), shapes)
    own = F.reverse(F.array_sort(F.transform(own, lambda k: F.struct(F.char_length(k).alias("n"), k.alias("key")))))["key"]
    hosts = F.transform(keys_of(F.col("host"), F.lit(""), [(n, 0) for n in depths]), lambda k: F.concat(k, F.lit("?")))
    keyed = parts.withColumn("own", own).withColumn("keys", F.concat("own", hosts))
    universe = keyed.select(F.explode("keys").alias("key")).distinct()
    universe = materialize(universe, "url-keys")
    listed = ruled.where("block").select("key").union(blocked.select(F.concat("host", F.lit("?"))))
    is_rule = spark.sparkContext.broadcast(build(universe, ruled).levels)
    is_blocked = spark.sparkContext.broadcast(build(universe, listed).levels)

    def run(batches):
        rule_of, block_of = Cascade(is_rule.value), Cascade(is_blocked.value)
        for batch in batches:
            h = [pa.array(batch.column(c)) for c in ("h1", "h2")]
            h1, h2 = (a.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for a in h)
            rule, block = rule_of.holds(h1, h2), block_of.holds(h1, h2)
            ends = np.cumsum([0, *(len(x) for x in h[0].to_pylist())]).tolist()
            first, verdict = [], []
            for a, b in zip(ends, ends[1:]):
                at = next((i for i in range(a, b) if rule[i]), None)
                first.append(None if at is None else at - a)
                verdict.append("block" if (block[a:b].any() if at is None else block[at]) else "allow")
            out = [batch.column(c) for c in ("page_id", "host", "path", "keys")] + [pa.array(first, pa.int32()), pa.array(verdict)]
            yield pa.RecordBatch.from_arrays(out, names=["page_id", "host", "path", "keys", "first", "verdict"])

    hashed = keyed.select("page_id", "host", "path", "keys", F.transform("keys", lambda k: _hashes(k)[0]).alias("h1"),
                          F.transform("keys", lambda k: _hashes(k)[1]).alias("h2"))
    kind = pages.schema["page_id"].dataType.simpleString()
    judged = hashed.mapInArrow(run, f"page_id {kind}, host string, path string, keys array<string>, first int, verdict string")
    return judged.select("page_id", "host", "path", F.col("keys")[F.col("first")].alias("rule"), "verdict")
