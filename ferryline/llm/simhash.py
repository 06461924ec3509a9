"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Fingerprints at most `bits` apart must, if the bits are dealt into m parts with
thresholds t1..tm that add up to bits - m + 1, agree in some part i to within ti
(-1: the part is not probed).  Correlated bits share a part, so that parts are
as independent as they can be; each fingerprint gets its own thresholds, chosen
by dynamic programming on the number of candidates each choice is expected to
bring; it probes the parts and every candidate is verified.

A bucket of the index holding more than `CROWD` fingerprints isn't probed: all
fingerprints that touch one are linked through midpoints instead.  Two are at
most 2r apart if and only if some point is within r of both, and a point has few
neighbours, so the crowded case is as exact and takes rows in proportion.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import map_batches
from ferryline.llm.components import components
from ferryline.session import materialize

BITS = 64
SEED = 42
CROWD = 64
COMMON = 1_000  # most frequent part values whose exact counts refine the estimate


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words, or of all words if they are fewer; A-Z lowered."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII blanks cut
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)] if words else [], "<u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], "<u8")


def majority(hashes: np.ndarray) -> int:
    """64 bits: a bit is set if it is in over half of the hashes; of none, zero."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of all shingles of a text, repeats included; no words, zero."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""
    def run(batch: pa.RecordBatch) -> dict:
        marks = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "fp": np.array(marks, np.uint64).view(np.int64)}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def _as_bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how often both are set; 4,096 sums reach the driver."""
    def run(batches):
        both, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 1 << 14):
                bits = _as_bits(values[at : at + (1 << 14)]).astype(np.float32)
                both += bits.T @ bits
            rows += len(values)
        if rows:
            cells = np.append(both.ravel(), rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    cells = np.zeros(BITS * BITS + 1)
    for cell, n in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        cells[cell] = n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def correlated_parts(rows: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in groups of near equal size, each grown around the bit that follows the others most."""
    mean = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs(both / max(rows, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        free = sorted(left)
        group = [max(free, key=lambda b: (round(tie[b, free].sum(), 9), -b))]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (round(tie[b, group].sum(), 9), -b)))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def thresholds(values: np.ndarray, groups: list[list[int]], mean: np.ndarray, rows: int, bits: int,
               common: dict[tuple[int, int], int]) -> np.ndarray:
    """For each fingerprint a threshold per part, at least expected cost; they add up to bits - parts + 1.

    Expected candidates within t of a part's value: rows times the chance of it
    if bits were independent, or its exact count if the value is a common one.
    """
    n, steps = len(values), bits + 2  # a threshold is a number of steps less one
    set_ = _as_bits(values).astype(bool)
    agree = np.clip(np.where(set_, mean, 1 - mean), 1e-6, 1 - 1e-6)
    cost = np.zeros((len(groups), n, steps))
    for i, group in enumerate(groups):
        p = agree[:, group]
        odds = (1 - p) / p
        sums = np.ones((n, 1))  # elementary symmetric sums of the odds: the chance of exactly t flips
        sums = np.concatenate([sums, np.zeros((n, steps - 2))], axis=1)
        for j in range(len(group)):
            sums[:, 1:] = sums[:, 1:] + sums[:, :-1] * odds[:, j : j + 1]
        found = rows * p.prod(axis=1)[:, None] * np.cumsum(sums, axis=1)
        masked = values & _mask(group)
        exact = np.array([common.get((i, v), 0) for v in masked.tolist()])
        probes = np.cumsum([len(list(itertools.combinations(range(len(group)), t))) for t in range(steps - 1)])
        cost[i, :, 1:] = np.maximum(found, exact[:, None]) + probes[None, :]
    best = np.full((n, steps), np.inf)
    best[:, 0] = 0
    taken = []
    for i in range(len(groups)):
        options = np.full((n, steps, steps), np.inf)  # total steps so far, steps in this part
        for u in range(steps):
            options[:, u:, u] = best[:, : steps - u] + cost[i, :, u : u + 1]
        taken.append(options.argmin(axis=2))
        best = options.min(axis=2)
    out, at = np.empty((n, len(groups)), np.int64), np.full(n, steps - 1)
    for i in reversed(range(len(groups))):
        out[:, i] = taken[i][np.arange(n), at]
        at = at - out[:, i]
    return out - 1


def _mask(group: list[int]) -> np.int64:
    return np.uint64(sum(1 << b for b in group)).astype(np.int64)


def _flips(group: list[int], radius: int) -> np.ndarray:
    """Patterns of up to `radius` bits of a part, the empty one first."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(group, r)],
                    np.uint64).view(np.int64)


def links(fps: DataFrame, bits: int = 2, parts: int | None = None) -> DataFrame:
    """(space, a, b): pairs of fingerprints of a space from which reachability follows.

    `fps` has distinct (space: int, fp: long).  Where buckets are small these are
    all pairs at most `bits` apart; in crowded ones each fingerprint is tied to
    the least one around each midpoint, which leaves reachability as it is.  An
    odd `bits` verifies those pairs.
    """
    parts = parts or bits + 1
    rows, both = bit_statistics(fps)
    groups = correlated_parts(rows, both, parts)
    mean = np.diag(both) / max(rows, 1)
    index = fps.select("space", "fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(int(_mask(g)))).alias("value"))
        for i, g in enumerate(groups)])).alias("k")).select("space", "k.part", "k.value", F.col("fp").alias("other"))
    key = ["space", "part", "value"]
    crowded = materialize(index.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > CROWD), "crowded")
    frequent = crowded.orderBy(F.desc("n"), *key).limit(COMMON).collect()
    common = {(r["part"], r["value"]): r["n"] for r in reversed(frequent)}

    def probe(batch: pa.RecordBatch) -> dict:
        spaces, values = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("space", "fp"))
        chosen = thresholds(values, groups, mean, rows, bits, common)
        out = []
        for i, group in enumerate(groups):
            for t in range(bits + 1):
                own = chosen[:, i] == t
                flips = _flips(group, t)
                keys = (values[own] & _mask(group))[:, None] ^ flips[None, :]
                out.append((np.repeat(spaces[own], len(flips)), np.full(keys.size, i, np.int32), keys.ravel(),
                            np.repeat(values[own], len(flips))))
        return {name: np.concatenate(c) for name, c in zip((*key, "fp"), zip(*out))}

    probes = materialize(map_batches(fps.select("space", "fp"), probe, "space int, part int, value long, fp long", 4096), "probes")
    small = index.join(crowded.select(*key), key, "left_anti")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    near = probes.join(small, key).where((F.col("fp") != F.col("other")) & (apart <= bits)).select(
        "space", F.col("fp").alias("a"), F.col("other").alias("b"))
    touched = probes.join(crowded.select(*key), key, "left_semi").select("space", "fp").union(
        index.join(crowded.select(*key), key, "left_semi").select("space", F.col("other").alias("fp"))).distinct()
    balls = [F.lit(int(x)) for x in _flips(list(range(BITS)), (bits + 1) // 2)]
    around = touched.select("space", "fp", F.explode(
        F.transform(F.array(*balls), lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    met = around.groupBy("space", "point").agg(F.sort_array(F.collect_list("fp")).alias("f")).where(F.size("f") > 1)
    if bits % 2 == 0:
        ties = met.select("space", F.col("f")[0].alias("a"), F.explode("f").alias("b")).where("a <> b")
    else:
        ties = met.select("space", F.explode("f").alias("a"), "f").select("space", "a", F.explode("f").alias("b")).where(
            "a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return near.union(ties)


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of `docs` (doc_id, text).

    Two rows are linked if their fingerprints differ in at most `bits` bits;
    component_id is the smallest doc_id reachable.  Rows without words (null,
    empty, blanks) have fingerprint zero and are linked like any other.  Equal
    and repeated rows are linked; each row comes back once.  A null doc_id is
    never the smallest unless the component has no other.  Other columns of
    `docs` are ignored; an empty table gives an empty one.
    """
    marks = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = materialize(components(
        links(distinct.select(F.lit(0).alias("space"), "fp"), bits).select("a", "b")), "fingerprint-roots")
    linked = roots.join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    labels = distinct.join(linked.join(least, "root").select("fp", "least_id"), "fp", "left").select(
        "fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return marks.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
