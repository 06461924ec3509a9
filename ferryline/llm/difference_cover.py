"""Substring dedup with difference-cover anchors.

Documents are dealt into groups of a few megabytes.  Of each document only the
windows of `ANCHOR` words that start at positions p with p mod 7 in {0, 1, 3} are
hashed: any two positions can be moved by the same step below 7 so that both are
such positions, so two documents that share 13 words share an anchor at the same
place of the match.  Groups send each anchor once; anchors met in two documents
are extended to every 13-word window around them, and those windows, identified
by 128 bits, get the least doc_id they start in.  What is sent is one row per
group and part, never a row per pair; a passage shared by everything is sent once
per group.  All three readers of the texts use one shuffle of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import mix64, text_bytes

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)  # every difference modulo 7 is one of two members of the cover
ANCHOR = WINDOW - PERIOD + 1
GROUP_BYTES = 4 << 20
PART_BYTES = 24 << 20
LONG_WORD = 64  # bytes; longer words are hashed one by one

_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_U = np.uint64


def _constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


class Words:
    """The words of some texts, as positions in one byte array."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        self.bytes = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        blank = _BLANK[self.bytes]
        edge = np.flatnonzero(np.diff(blank, prepend=True))  # blanks to word and back, in turn
        self.starts, self.ends = edge[0::2], edge[1::2]
        begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
        self.first = np.searchsorted(self.starts, begins)  # of each document, and the end
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))
        self.place = np.arange(len(self.starts)) - self.first[self.doc]
        self.rest = self.first[self.doc + 1] - np.arange(len(self.starts))  # words from here to the document's end

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        value, power = _constants(256, seed), np.cumprod(np.full(LONG_WORD + 1, _constants(1, seed + 1)[0]), dtype=np.uint64)
        lengths = self.ends - self.starts
        for at in range(0, len(out), 1 << 16):
            starts, size = self.starts[at : at + (1 << 16)], np.minimum(lengths[at : at + (1 << 16)], LONG_WORD)
            begins = np.cumsum(size) - size
            offset = np.arange(begins[-1] + size[-1]) - np.repeat(begins, size)
            terms = value[self.bytes[np.repeat(starts, size) + offset]] * power[offset]
            out[at : at + (1 << 16)] = np.add.reduceat(terms, begins)
        out = mix64(out + lengths.astype(np.uint64) * _constants(1, seed + 2)[0])
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.bytes[self.starts[i] : self.ends[i]].tobytes(), seed)
        return out

    def windows(self, hashes: np.ndarray, at: np.ndarray, width: int, seed: int) -> np.ndarray:
        """A hash of the `width` words from each position in `at`."""
        out = np.zeros(len(at), np.uint64)
        for k, c in enumerate(_constants(width, seed)):
            out += hashes[at + k] * c
        return mix64(out)

    def anchors(self, hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions of documents in `known` that some window can hold, and their hashes."""
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.rest >= ANCHOR) & known[self.doc])
        at = at[self.place[at] + self.rest[at] >= WINDOW]
        return at, self.windows(hashes, at, ANCHOR, 11)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> _U(40)) * _U(parts) >> _U(24)).astype(np.int32)


def _cut(key: np.ndarray, columns: dict[str, np.ndarray], **same) -> pa.Table:
    """One row per value of `key` (sorted), the rows' values of each column as bytes."""
    edges = np.flatnonzero(np.diff(key, prepend=key[:1] - 1 if len(key) else []))
    spans = list(zip(edges.tolist(), [*edges[1:].tolist(), len(key)]))
    data = {name: pa.array([key[a] for a, _ in spans], pa.int32()) if v is None else
            pa.array([v[a:b].tobytes() for a, b in spans], pa.binary()) for name, v in columns.items()}
    return pa.table(data | {name: pa.array([v] * len(spans), pa.int32()) for name, v in same.items()})


def _joined(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _group_of(table: pa.Table) -> int:
    return table.column("grp")[0].as_py()


def _known(table: pa.Table) -> np.ndarray:
    return ~table.column("doc_id").is_null().to_numpy()


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(0).to_numpy()


def anchors_of(parts: int):
    """A group's anchors, each once; the lowest bit tells whether two of its documents have it."""
    def run(table: pa.Table) -> pa.Table:
        words = Words(table.column("text").to_pylist())
        at, found = words.anchors(words.hashes(1), _known(table))
        found &= ~_U(1)
        order = np.argsort(found, kind="stable")
        found, doc = found[order], words.doc[at[order]]
        new = np.flatnonzero(np.diff(found, prepend=~found[:1]))
        if not len(new):
            return _cut(np.array([], np.int32), {"part": None, "anchors": found}, grp=0)
        many = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)
        found = found[new] | many.astype(np.uint64)
        return _cut(_part(found, parts), {"part": None, "anchors": found}, grp=_group_of(table))

    return run


def shared_anchors(table: pa.Table) -> pa.Table:
    """For each group, its anchors that another document has as well."""
    found = _joined(table, "anchors", "<u8")
    group = np.repeat(table.column("grp").to_numpy(), [len(b) // 8 for b in table.column("anchors").to_pylist()])
    order = np.argsort(found, kind="stable")
    found, group = found[order], group[order]
    new = np.flatnonzero(np.diff(found >> _U(1), prepend=~(found[:1] >> _U(1))))
    size = np.diff([*new.tolist(), len(found)])
    shared = np.repeat((size > 1) | (np.bitwise_or.reduceat(found, new) & _U(1)).astype(bool), size)
    found, group = found[shared] & ~_U(1), group[shared]
    order = np.argsort(group, kind="stable")
    return _cut(group[order], {"grp": None, "anchors": found[order]})


def windows_around(parts: int):
    """A group's windows around shared anchors, each once, with the least doc_id and whether there are more."""
    def run(texts: pa.Table, shared: pa.Table) -> pa.Table:
        empty = _cut(np.array([], np.int32), {"part": None, "w1": np.array([]), "w2": np.array([]), "least": np.array([]),
                                              "many": np.array([])}, grp=0)
        if not shared.num_rows or not texts.num_rows:
            return empty
        words = Words(texts.column("text").to_pylist())
        h1 = words.hashes(1)
        at, found = words.anchors(h1, _known(texts))
        at = at[np.isin(found & ~_U(1), _joined(shared, "anchors", "<u8"))]
        reach = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(reach, at - np.minimum(words.place[at], WINDOW - ANCHOR), 1)
        np.add.at(reach, at + 1, -1)
        at = np.flatnonzero((np.cumsum(reach)[:-1] > 0) & (words.rest >= WINDOW))
        if not len(at):
            return empty
        w1, w2 = words.windows(h1, at, WINDOW, 21), words.windows(words.hashes(2), at, WINDOW, 22)
        ids = _ids(texts)[words.doc[at]]
        order = np.lexsort((w2, w1))
        w1, w2, ids = w1[order], w2[order], ids[order]
        new = np.flatnonzero(np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
        least, most = np.minimum.reduceat(ids, new), np.maximum.reduceat(ids, new)
        order, w1, w2 = order[new], w1[new], w2[new]
        part, many = _part(w1, parts), least != most
        order = np.lexsort((order, part))  # as in the texts: runs of equal ids take no room in the shuffle
        return _cut(part[order], {"part": None, "w1": w1[order], "w2": w2[order], "least": least[order], "many": many[order]},
                    grp=_group_of(texts))

    return run


def least_ids(table: pa.Table) -> pa.Table:
    """For each group, its windows that start in a document before the group's last, with the least doc_id of all."""
    w1, w2, least = _joined(table, "w1", "<u8"), _joined(table, "w2", "<u8"), _joined(table, "least", "<i8")
    many = _joined(table, "many", "?")
    group = np.repeat(table.column("grp").to_numpy(), [len(b) for b in table.column("many").to_pylist()])
    order = np.lexsort((w2, w1))
    w1, w2, least, many, group = (x[order] for x in (w1, w2, least, many, group))
    new = np.flatnonzero(np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
    first = np.repeat(np.minimum.reduceat(least, new), np.diff([*new.tolist(), len(w1)]))
    told = (first < least) | many
    w1, w2, first, group = w1[told], w2[told], first[told], group[told]
    order = np.lexsort((first, group))
    return _cut(group[order], {"grp": None, "w1": w1[order], "w2": w2[order], "first": first[order]})


def _repeated(words: Words, ids: np.ndarray, known: np.ndarray, found: pa.Table) -> np.ndarray:
    """Which words lie in a window that also starts in a document with a smaller id."""
    covered = np.zeros(len(words.starts) + 1, np.int64)
    at = np.flatnonzero((words.rest >= WINDOW) & known[words.doc])
    if found.num_rows and len(at):
        f1, f2, first = _joined(found, "w1", "<u8"), _joined(found, "w2", "<u8"), _joined(found, "first", "<i8")
        order = np.argsort(f1, kind="stable")
        f1, f2, first = f1[order], f2[order], first[order]
        w1 = words.windows(words.hashes(1), at, WINDOW, 21)
        spot = np.searchsorted(f1, w1)
        hit = spot < len(f1)
        hit[hit] = f1[spot[hit]] == w1[hit]
        at, w1, spot = at[hit], w1[hit], spot[hit]
        w2 = words.windows(words.hashes(2), at, WINDOW, 22) if len(at) else w1
        repeated = np.zeros(len(at), bool)
        while len(at) and (live := (spot < len(f1)) & (f1[np.minimum(spot, len(f1) - 1)] == w1)).any():
            here = np.minimum(spot, len(f1) - 1)
            repeated |= live & (f2[here] == w2) & (first[here] < ids[words.doc[at]])
            spot = spot + 1  # windows that share only the first 64 bits
        np.add.at(covered, at[repeated], 1)
        np.add.at(covered, at[repeated] + WINDOW, -1)
    return np.cumsum(covered)[:-1] > 0


def keep_rest(texts: pa.Table, found: pa.Table) -> pa.Table:
    """The group's rows with the words that are left."""
    raw = texts.column("text").to_pylist()
    words = Words(raw)
    gone = _repeated(words, _ids(texts), _known(texts), found)
    n_words, n_gone = np.diff(words.first), np.diff(np.append(0, np.cumsum(gone))[words.first])
    kept = []
    for i, text in enumerate(raw):
        parts = (text or "").encode().split()
        if n_gone[i]:
            parts = [p for p, g in zip(parts, gone[words.first[i] : words.first[i + 1]].tolist()) if not g]
        kept.append(b" ".join(parts).decode())
    return texts.drop_columns(["grp"]).append_column("n_words", pa.array(n_words, pa.int64())).append_column(
        "n_removed", pa.array(n_gone, pa.int64())).append_column("kept_text", pa.array(kept, pa.string()))


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, columns named in `keep`, n_words, n_removed, kept_text) for each row of `docs`.

    A word goes if one of the 13-word windows that cover it also starts in a
    document with a smaller doc_id, judged on the texts as given; kept words are
    joined by one space.  A null text has no words.  A row without doc_id loses
    nothing and makes others lose nothing; rows of the same doc_id don't affect
    each other; repeated rows come back as often as they came.  Columns not
    named are left out.  An empty table gives an empty one.
    """
    size = text_bytes(docs)
    groups, parts = max(1, -(-size // GROUP_BYTES)), max(1, -(-size // PART_BYTES))
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep]
    rows = docs.select(*columns)
    texts = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    by_group = texts.groupBy("grp")
    sent = by_group.applyInArrow(anchors_of(parts), "part int, anchors binary, grp int")
    shared = sent.groupBy("part").applyInArrow(shared_anchors, "grp int, anchors binary")
    windows = by_group.cogroup(shared.groupBy("grp")).applyInArrow(
        windows_around(parts), "part int, w1 binary, w2 binary, least binary, many binary, grp int")
    found = windows.groupBy("part").applyInArrow(least_ids, "grp int, w1 binary, w2 binary, first binary")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields])
    return by_group.cogroup(found.groupBy("grp")).applyInArrow(
        keep_rest, f"{schema}, n_words long, n_removed long, kept_text string")
