"""Periodic runs of words: stretches that repeat a block four times or more.

A run is a stretch of consecutive words of smallest period q (words q apart are
the same), of length 4 q and 6 words at least, that no neighbouring word extends.

Periods up to `SHORT` are found by direct lag scans.  Above, scale by scale: the
scale of P looks for periods in (P, 2 P].  Every stretch of 2 P words (a gram) has
an exact name, made by doubling: the name of a gram is the rank of the pair of
names of its halves.  Of each P grams in a row the one of least mixed name is
kept, a minimizer.  A run of such a period q holds two windows of P grams that
are q apart and the same, so it keeps two equal minimizers q apart; as a gram is no shorter
than q, none lies between them.  So neighbours among the equal minimizers of a
scale, P to 2 P apart, seed all runs of the scale; each seed is extended both
ways by halving steps over the names, and kept if it repeats often enough.

All documents of a batch are searched at once, as one long sequence of word
numbers in which a number used only once parts one document from the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPEATS = 4  # times a run repeats its period, at least
LEAST = 6  # words of a run, at least
SHORT = 8  # longest period that lag scans look for
BATCH_BYTES = 4 << 20  # of the texts searched at once; a longer text goes alone
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _mixed(names: np.ndarray) -> np.ndarray:
    """32 well mixed bits of each name, different for different names."""
    x = names.astype(np.uint32)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    return x ^ (x >> np.uint32(16))


def _doubled(names: np.ndarray, step: int) -> np.ndarray:
    """Names of the grams twice as long as those of `names`, which are `step` words long."""
    pairs = names[:-step].astype(np.int64) << 32 | names[step:]
    return np.unique(pairs, return_inverse=True)[1].astype(np.int32)


def _minimizers(names: np.ndarray, window: int) -> np.ndarray:
    """Positions, rising, of the least mixed name (the first of equal ones) of each `window` (a power of two) names in a row."""
    keys = _mixed(names).astype(np.uint64) << np.uint64(32) | np.arange(len(names), dtype=np.uint64)
    span = 1
    while span < window:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.unique(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _same_ahead(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words from each position `a` on that equal those from `b` on."""
    n = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, last = levels[k], len(levels[k]) - 1
        fits = np.maximum(a, b) + n <= last
        same = fits & (names[np.minimum(a + n, last)] == names[np.minimum(b + n, last)])
        n += same.astype(np.int64) << k
    return n


def _same_behind(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words right before each position `a` that equal those right before `b`."""
    n = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, last = levels[k], len(levels[k]) - 1
        at, other = a - n - (1 << k), b - n - (1 << k)
        fits = (np.minimum(at, other) >= 0) & (np.maximum(at, other) <= last)
        same = fits & (names[np.clip(at, 0, last)] == names[np.clip(other, 0, last)])
        n += same.astype(np.int64) << k
    return n


def _long_enough(lag: np.ndarray | int) -> np.ndarray:
    """Words in a row that must equal those `lag` before them in a run."""
    return np.maximum(LEAST, REPEATS * lag) - lag


def _lag_scan(words: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the stretches of that period."""
    same = np.zeros(max(0, len(words) - lag) + 2, np.int8)
    same[1:-1] = words[lag:] == words[:-lag]
    edges = np.flatnonzero(np.diff(same))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= _long_enough(lag)
    return starts[keep], (ends - starts)[keep] + lag


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in `words` (int32), by start, then period.

    `words` are documents end to end, longest first; `sizes` counts the words of
    each, with the one behind it that parts it from the next and occurs nowhere else.
    Takes about 4 bytes a word for each doubling of the longest document.
    """
    ends = np.cumsum(sizes)

    def reach(least: int) -> int:
        """Where the documents of `least` words or more end."""
        n = int(np.searchsorted(-sizes, -least, "right"))
        return int(ends[n - 1]) if n else 0

    found = [(*_lag_scan(words[: reach(LEAST)], q), q) for q in range(1, SHORT + 1) if reach(LEAST) > q]
    starts, lengths, periods = [[f[0] for f in found], [f[1] for f in found], [np.full(len(f[0]), f[2]) for f in found]]
    levels = [words]
    while (size := 2 << (len(levels) - 1)) and (cut := reach(size)) >= size:
        levels.append(_doubled(levels[-1][: cut - size // 2 + 1], size // 2))
    scale = SHORT
    while (cut := reach(REPEATS * (scale + 1))) >= REPEATS * (scale + 1):
        names = levels[(2 * scale).bit_length() - 1][: cut - 2 * scale + 1]
        at = _minimizers(names, scale)
        at = at[np.argsort(names[at], kind="stable")]
        lag = np.diff(at)
        seeds = (np.diff(names[at]) == 0) & (lag > scale) & (lag <= 2 * scale)
        a, lag = at[:-1][seeds], lag[seeds]
        before, after = _same_behind(levels, a, a + lag), _same_ahead(levels, a, a + lag)
        keep = before + after >= _long_enough(lag)
        starts.append((a - before)[keep])
        lengths.append((before + after + lag)[keep])
        periods.append(lag[keep])
        scale *= 2
    start, length, period = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, lengths, periods))
    # a multiple of a run's period spans the same words: the least period stays
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _batch_runs(texts: list[bytes | None]) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each text."""
    words = [t.split() if t else [] for t in texts]  # bytes.split() cuts at the ASCII blanks
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    sizes = np.array([len(words[i]) + 1 for i in order], np.int64)
    ends = np.cumsum(sizes)
    coded = pa.array([w for i in order for w in words[i]], pa.binary()).dictionary_encode()
    sequence = np.empty(int(sizes.sum()), np.int32)
    is_word = np.ones(len(sequence), bool)
    is_word[ends - 1] = False
    sequence[is_word] = coded.indices.to_numpy()
    sequence[ends - 1] = len(coded.dictionary) + np.arange(len(sizes))
    start, length, period = find_runs(sequence, sizes)
    dropped = np.zeros(len(sequence) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    kept = np.cumsum(dropped[:-1]) == 0
    owner = np.searchsorted(ends, start, "right")
    bounds = np.searchsorted(owner, np.arange(len(sizes) + 1))
    runs: list[list[dict]] = [[] for _ in texts]
    collapsed: list[bytes] = [b""] * len(texts)
    for k, i in enumerate(order):
        here = slice(bounds[k], bounds[k + 1])
        if here.start == here.stop:
            collapsed[i] = b" ".join(words[i])
            continue
        base = int(ends[k] - sizes[k])
        runs[i] = [{"start": s - base, "length": n, "period": q}
                   for s, n, q in zip(start[here].tolist(), length[here].tolist(), period[here].tolist())]
        stays = kept[base : base + len(words[i])]
        collapsed[i] = b" ".join(w for w, stay in zip(words[i], stays.tolist()) if stay)
    return runs, collapsed


def _portions(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, so many at a time that their texts take about `BATCH_BYTES`."""
    bytes_so_far = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = bytes_so_far[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(bytes_so_far, before + BATCH_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `runs` (start in words from 0, length, period; by start, then period) and `collapsed`.

    `collapsed` has the words, joined by single spaces, without those that lie in
    any run behind its first period.  Words are runs of anything but ASCII blanks.
    A null, empty or blank text has no runs and collapses to an empty text; rows
    are judged one by one, so null, repeated or tied ids don't matter and an empty
    table gives none.  A column named `runs` or `collapsed` is replaced; all others,
    however named, are kept.  Nothing is shuffled.
    """
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    plain = docs.select(*kept, F.col(text).cast("string").alias("collapsed"))
    schema = plain.withColumn("runs", F.lit(None).cast(RUNS)).select(*kept, "runs", "collapsed").schema

    def run(batches):
        for batch in batches:
            for rows in _portions(batch, "collapsed"):
                runs, collapsed = _batch_runs(rows.column("collapsed").cast(pa.binary()).to_pylist())
                spans = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in kept], pa.array(runs, spans), pa.array(collapsed, pa.binary()).cast(pa.string(), safe=False)],
                    names=[*kept, "runs", "collapsed"])

    return plain.mapInArrow(run, schema)


def highest_run(runs: str = "runs") -> Column:
    """The run of greatest length for its period; of equal ones the first, then that of least period; null if there is none."""
    def rank(r):
        # distinct quotients of numbers below 2^26 are distinct doubles
        return F.struct((r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("s"), (-r["period"]).alias("p"),
                        r["length"].alias("length"))

    best = F.array_max(F.transform(runs, rank))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))
