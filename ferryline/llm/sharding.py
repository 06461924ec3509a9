"""Shards by best-fit-decreasing bin packing of indivisible groups.

Groups are first packed into crates, small bins, by independent tasks; crates and
the groups larger than one are then packed into the shards.  Both steps take the
items from the largest to the smallest and put each into the bin with the least
room that still holds it, found in a balanced tree of the bins' room.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferryline.session import materialize

CRATES = 512  # crates that fill a shard, about
REGION = 200_000  # groups packed by one task, about
SLICE = 20_000  # rows of a crate numbered by one task, about


class Rooms:
    """Bins by the room they have left: a treap, balanced by a hash of the bin's number."""

    def __init__(self):
        self.root = None

    def add(self, room: int, bin_: int) -> None:
        self.root = self._join(*self._around(self.root, (room, bin_), [(room, bin_), xxhash.xxh32_intdigest(str(bin_)), None, None]))

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the (room, bin) of least room that is at least `size`; None if no bin has it."""
        node, found = self.root, None
        while node:
            if node[0][0] >= size:
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found:
            below, rest = self._split(self.root, found)
            self.root = self._join(below, self._split(rest, (found[0], found[1] + 1))[1])
        return found

    def _around(self, root, key, node):
        below, rest = self._split(root, key)
        return self._join(below, node), rest

    def _split(self, node, key):
        """Nodes below `key`, and the others."""
        if not node:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            node[3] = a
            return node, b
        a, b = self._split(node[2], key)
        node[2] = b
        return a, node

    def _join(self, a, b):
        if not a or not b:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> list[int]:
    """The bin (from 0) of each item of `sizes`, which must come from large to small.

    An item above the capacity gets a bin of its own.
    """
    rooms, bins, out = Rooms(), 0, []
    for size in sizes:
        found = rooms.take_tightest(size)
        if found is None:
            found, bins = (capacity, bins), bins + 1
        out.append(found[1])
        if found[0] > size:
            rooms.add(found[0] - size, found[1])
    return out


def least_capacity(sizes: list[int], bins: int) -> tuple[int, list[int]]:
    """A capacity near the least with which the items (large to small) fit into `bins`, and their bins."""
    if not sizes:
        return 0, []
    low = max(sizes[0], -(-sum(sizes) // bins))
    steps = [low + low * k // 4096 for k in range(64)] + [low + low * 2**k // 64 for k in range(8)]
    tried = {}

    def fits(capacity):
        tried[capacity] = best_fit_decreasing(sizes, capacity)
        return max(tried[capacity]) < bins

    at = bisect.bisect_left(steps, True, key=fits)
    return steps[at], tried.get(steps[at]) or best_fit_decreasing(sizes, steps[at])


def pack(groups: DataFrame, bins: int) -> DataFrame:
    """(key, crate, shard) for each group of `groups` (key, size: long): sizes near equal, no group divided.

    A group larger than a shard's fair share stays whole and makes its shard the
    larger.  What reaches the driver is one row per crate: about `CRATES` times
    the bins, one more per task, and as many groups as can exceed a crate.
    """
    n, total = groups.agg(F.count("*"), F.sum(F.col("size").cast("decimal(38,0)"))).first()
    capacity = max(1, int(total or 0) // (bins * CRATES))
    regions = max(1, -(-n // REGION))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        return pdf.assign(crate=best_fit_decreasing(pdf["size"].tolist(), capacity))

    crated = materialize(
        groups.withColumn("region", F.pmod(F.xxhash64("key"), F.lit(regions)).cast("int")).groupBy("region").applyInPandas(
            fill, "key string, size long, region int, crate int"), "crates")
    crates = crated.groupBy("region", "crate").agg(F.sum("size").alias("size")).collect()
    crates.sort(key=lambda r: (-r["size"], r["region"], r["crate"]))
    shards = least_capacity([r["size"] for r in crates], bins)[1]
    spark = groups.sparkSession
    places = spark.createDataFrame([(r["region"], r["crate"], i, s) for i, (r, s) in enumerate(zip(crates, shards))],
                                   "region int, crate int, place int, shard int")
    return crated.join(places, ["region", "crate"]).select("key", F.col("place").alias("crate"), "shard")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of `docs` (doc_id, text); rows with equal texts stay together.

    Size is the text's UTF-8 bytes plus 1.  A null text counts as an empty one.
    Slots number a shard's rows from 0, crate by crate, by doc_id (null first)
    within one of a crate's slices; a shard may stay empty.  Other columns of
    `docs` are ignored; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialize(docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.sha2(text, 224).alias("key")), "sized")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    packed = pack(groups.select("key", "size"), shards)
    slices = groups.join(packed, "key").groupBy("crate", "shard").agg(
        F.ceil(F.sum("n") / F.lit(SLICE)).cast("int").alias("slices"))
    cut = F.pmod(F.xxhash64("doc_id", "key"), F.col("slices")).cast("int")
    placed = materialize(
        rows.join(packed, "key").join(slices.drop("shard"), "crate").select(
            "doc_id", "size", "text_crc32", "shard", "crate", cut.alias("slice")), "placed")
    counts = placed.groupBy("shard", "crate", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(_window("shard", "crate", "slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("crate", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    spot = F.row_number().over(_window(["crate", "slice"], "doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("spot", spot).join(offsets, ["crate", "slice"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("spot")).cast("long").alias("slot"))


def _window(keys, *order):
    return Window.partitionBy(keys).orderBy(*order)
