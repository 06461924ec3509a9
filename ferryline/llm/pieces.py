"""SentencePiece encoding and decoding with a BPE model, by vectorised merge rounds.

The distinct words of some texts are laid out in one flat symbol array.  In each
round every word finds its pair of least rank (the leftmost of them), all words
merge theirs at once, and the array is compacted, until no word has a pair left.
Ranks of pairs are kept and only looked up anew beside a merge.  One merge per word
and round keeps the library's order of merges, in which a new pair may come
before an old one.  Words of over `LONG` symbols, where rounds would not pay,
merge the same way from a heap.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import map_batches

SPACE = "▁"
NONE = np.int64(1) << 40  # rank of a pair that doesn't merge
LONG = 200
CACHE = 80_000  # words remembered by a worker, in each of two generations


class Pieces:
    """A BPE model with byte fallback as arrays; texts in, ids out, and back."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = {names[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if len(self.byte_ids) < 256 or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("the model must have byte pieces and no unused ones")
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        # symbols: all pieces, and characters that only occur within pieces
        chars = sorted({c for p in plain for c in p} - set(plain))
        self.symbol = plain | {c: n + i for i, c in enumerate(chars)}
        self.symbols = n + len(chars)
        scores = sorted({sp.get_score(i) for i in plain.values()}, reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        pairs = {}
        for piece, i in plain.items():
            for k in range(1, len(piece)):
                if piece[:k] in self.symbol and piece[k:] in self.symbol:
                    pairs[self.symbol[piece[:k]] * (self.symbols + 1) + self.symbol[piece[k:]]] = (rank[sp.get_score(i)], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        # a word may be cut out before a space that follows another character, as no piece reaches over it
        whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain)
        self.words = re.compile(r"(?s).+" if whole else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.char_symbol = np.full(0x110000, self.symbols, np.int64)
        for piece, i in self.symbol.items():
            if len(piece) == 1:
                self.char_symbol[ord(piece)] = i
        self.chars_of = [len(name) for name in names]
        self.text_of = [b""] * n
        for piece, i in plain.items():
            self.text_of[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.byte_ids.items():
            self.text_of[i] = bytes([byte])
        self.new, self.old = {}, {}

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * (self.symbols + 1) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.merged[at]

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each word."""
        out = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._ids(w, self._merge_long(w))
        if not short:
            return out
        flat = "".join(words[i] for i in short)
        sym = self.char_symbol[np.frombuffer(flat.encode("utf-32-le"), np.uint32)]
        size = np.array([len(words[i]) for i in short])
        word = np.repeat(np.arange(len(short)), size)
        rank, into = self._ranks(sym, word)
        ended = []  # (word, symbol) of the words that are done, by round
        while len(sym):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            done = least == NONE
            if done.any():
                left = np.repeat(~done, size)
                ended.append((word[~left], sym[~left]))
                sym, word, rank, into = sym[left], word[left], rank[left], into[left]
                least, size = least[~done], size[~done]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, size))
            hits = hits[np.diff(word[hits], prepend=-1) != 0]  # the leftmost of each word
            sym[hits] = into[hits]
            left = np.ones(len(sym), bool)
            left[hits + 1] = False
            at = hits - np.arange(len(hits))  # where the merged symbols are after the gaps close
            sym, word, rank, into = sym[left], word[left], rank[left], into[left]
            near = np.zeros(len(sym), bool)
            near[at] = near[at[at > 0] - 1] = True
            beside = np.flatnonzero(near)
            rank[beside], into[beside] = self._ranks(sym, word, beside)
        word, sym = (np.concatenate(parts) for parts in zip(*ended))
        order = np.argsort(word, kind="stable")
        word, sym = word[order], sym[order]
        ends = np.cumsum(np.bincount(word, minlength=len(short)))
        ids, at = sym.astype("<u4").tobytes(), 0
        for i, end in zip(short, (ends * 4).tolist()):
            out[i], at = ids[at:end], end
        starts = np.append(0, ends)
        for k in np.unique(word[sym >= len(self.text_of)]).tolist():
            out[short[k]] = self._ids(words[short[k]], sym[starts[k] : starts[k + 1]])
        return out

    def _ranks(self, sym, word, at=None):
        """Rank and result of the pair that starts at each position."""
        at = np.arange(len(sym)) if at is None else at
        after = np.minimum(at + 1, len(sym) - 1)
        rank, into = self._look_up(sym[at], sym[after])
        return np.where((after > at) & (word[at] == word[after]), rank, NONE), into

    def _merge_long(self, word: str) -> np.ndarray:
        sym = [self.symbol.get(c, self.symbols) for c in word]
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        width = self.symbols + 1
        heap = []

        def offer(i):
            j = after[i]
            if i >= 0 and j < len(sym) and (found := self.pairs.get(sym[i] * width + sym[j])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(len(sym) - 1):
            offer(i)
        while heap:
            _, i, a, b, into = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = into, -1, after[j]
            if after[i] < len(sym):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([s for s in sym if s >= 0], np.int64)

    def _ids(self, word: str, sym: np.ndarray) -> bytes:
        """Symbols as ids; characters that are no piece as their bytes."""
        if (sym < len(self.text_of)).all():
            return sym.astype("<u4").tobytes()
        ids, at = [], 0
        for s in sym.tolist():
            if s < len(self.text_of):
                ids.append(s)
                at += self.chars_of[s]
            else:
                ids += [self.byte_ids[b] for b in word[at].encode()]
                at += 1
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, little-endian and of 32 bits, with begin and end ids; null is an empty text."""
        cut = [self.words.findall(t) for t in self.library.normalize([t or "" for t in texts])] if texts else []
        found, fresh = {}, []
        for w in {w for ws in cut for w in ws}:
            ids = self.new.get(w) or self.old.get(w)
            if ids is None:
                fresh.append(w)
            else:
                found[w] = ids
        found.update(zip(fresh, self.merge(fresh)))
        self.new.update(found)
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        begin, end = (np.array([x], "<u4").tobytes() for x in (self.bos, self.eos))
        return [begin + b"".join([found[w] for w in ws]) + end for ws in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space put before the first word is taken off, broken byte runs show U+FFFD."""
        raw = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        raw = raw[1:] if raw[:1] == b" " else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The model of a worker, read once."""
    return Pieces(path)


def _mapped(df: DataFrame, new: dict[str, str], fn) -> DataFrame:
    """`df` with columns named and typed by `new`, which `fn` makes of a batch."""
    rest = df.drop(*new)

    def run(batch: pa.RecordBatch) -> dict:
        return {name: batch.column(name) for name in batch.schema.names} | fn(batch)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields] + [f"{c} {t}" for c, t in new.items()]
    return map_batches(rest, run, ", ".join(fields), 512)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """`docs` (text and any others) with `ids`: each text's ids as little-endian 32-bit integers, begin and end included.

    A null text is an empty one and has those two.  The model file must be at
    `path` on every executor.  A column named `ids` is replaced.
    """
    return _mapped(docs, {"ids": "binary"}, lambda batch: {
        "ids": pa.array(pieces(path).encode(batch.column("text").to_pylist()), pa.binary())})


def _decoded(path: str, ids: list[bytes | None]) -> pa.Array:
    model = pieces(path)
    return pa.array([None if x is None else model.decode(x) for x in ids], pa.string())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` (ids and any others) with `decoded`, the text of the ids; null ids give null."""
    return _mapped(encoded, {"decoded": "string"}, lambda batch: {"decoded": _decoded(path, batch.column("ids").to_pylist())})


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with `ids` and `decoded`: both ways in one pass, so that a task needs one worker."""
    def both(batch: pa.RecordBatch) -> dict:
        ids = pieces(path).encode(batch.column("text").to_pylist())
        return {"ids": pa.array(ids, pa.binary()), "decoded": _decoded(path, ids)}

    return _mapped(docs, {"ids": "binary", "decoded": "string"}, both)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's text.

    A null text is an empty one: begin and end ids only.  Repeated rows and rows
    without doc_id come back each; other columns are ignored; an empty table
    gives an empty one.
    """
    done = round_trip(docs.select("doc_id", "text"), path)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
