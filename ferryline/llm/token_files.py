"""Token ids in Arrow files of equal-length sequences.

A corpus is written as parts, each a range of doc_id: `tokens-*.arrow` (Arrow file
format) has fixed-size-list batches, the sequences with a mask that is false on
padding, so that sequence i is a slice of the mapped file without a copy;
`index-*.arrow` has doc_id, first place and number of tokens of each document.
Only a part's last sequence is padded.  Files get a name of their own per
attempt and a part counts once its row is in the manifest, so a lost executor
leaves at most files that nobody reads.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferryline.llm.common import slices, text_bytes
from ferryline.session import materialize, new_folder

END = 1
LENGTH = 2_048  # tokens of a sequence
BATCH = 512  # sequences of a batch
PART_BYTES = 48 << 20  # text of a part
CACHE = 250_000  # words, and pieces, remembered by a worker

_SAFE = re.compile("[!-~À-ÖØ-öø-ÿ]+")  # lowering and composing these is the same for a word alone
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Remembered(dict):
    """Results of a function by argument, in two generations of at most `CACHE` each: the older one goes as a whole."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got


class WordTokens:
    """Ids of texts by the tokenizers library, asked once per distinct piece.

    For a tokenizer that drops blanks and splits at them, a text's ids are those
    of its words in a row.  Words of plain Latin letters are split into the
    library's own pieces and looked up by its model; all others are left to the
    whole library.  Results are remembered, in two generations of bounded size.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in seen]  # bytes that don't print stand for characters from 256 on
        self.shown = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.words, self.pieces = Remembered(self._word), Remembered(self._piece)
        # the short cut holds for this kind of tokenizer only; a few words tell
        tries = ["Word", "don't", "x2.5!", "café,", "ÉTÉ***", "a_b-c&&&", "'re's", "ßÿ"]
        self.short_cut = all(self._plain(w) == self._whole(w) for w in tries)

    def _whole(self, word: str) -> bytes:
        return _packed(self.library.encode(word, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([self.shown[b] for b in piece.encode()])
        return _packed([t.id for t in self.model.tokenize(shown)])

    def _plain(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _SPLIT.findall(word.lower())))

    def _word(self, word: str) -> bytes:
        safe = self.short_cut and _SAFE.fullmatch(word) and "<|" not in word
        return self._plain(word) if safe else self._whole(word)

    def encode_all(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, `end` after each, and how many each has; null is an empty text.

        Texts are cut and their words numbered by Arrow; each distinct word is looked up
        once, and the ids of all places are gathered from those.
        """
        cut = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        words = pc.list_flatten(cut).dictionary_encode()
        known = [*map(self.words.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()), _packed([end])]
        offsets = np.zeros(len(known) + 1, np.int32)
        np.cumsum([len(k) >> 2 for k in known], out=offsets[1:])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(known), "<u4")))
        stop = np.cumsum(pc.list_value_length(cut).to_numpy(), dtype=np.int64)
        taken = lists.take(pa.array(np.insert(words.indices.to_numpy(), stop, len(known) - 1)))
        ends = taken.offsets.to_numpy()[stop + np.arange(1, len(stop) + 1)]
        return taken.flatten().to_numpy(), np.diff(ends, prepend=0).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null is an empty text."""
        flat, sizes = self.encode_all(pa.array(texts, pa.string()), END)
        return [x[:-1].tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])] if len(sizes) else []


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _files(uri: str):
    """The file system and path of a folder or file below the shared folder."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", uri))
    return system, path


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(kind, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class PartWriter:
    """Writes one part; holds a batch of sequences at a time."""

    def __init__(self, folder: str, name: str, kind: pa.DataType):
        system, path = _files(folder)
        system.create_dir(path, recursive=True)
        self.kind, self.left, self.held, self.total, self.documents = kind, [], 0, 0, 0
        self.sinks = [system.open_output_stream(f"{path}/{what}-{name}.arrow") for what in ("tokens", "index")]
        self.tokens, self.index = (pa.ipc.new_file(s, schema) for s, schema in zip(self.sinks, (_schema(kind), INDEX)))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents with the ids of all of them end to end."""
        starts = self.total + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(sizes)], schema=INDEX))
        self.left.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        self.documents += len(sizes)
        if self.held >= BATCH * LENGTH:
            flat = np.concatenate(self.left)
            whole = len(flat) // LENGTH * LENGTH
            for at in range(0, whole, BATCH * LENGTH):
                self._put(flat[at : min(at + BATCH * LENGTH, whole)])
            self.left, self.held = [flat[whole:]], len(flat) - whole

    def _put(self, flat: np.ndarray) -> None:
        padding = -len(flat) % LENGTH
        mask = np.arange(len(flat) + padding) < len(flat)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v, t), LENGTH) for v, t in (
            (np.pad(flat, (0, padding)), self.kind), (mask, pa.bool_()))]
        self.tokens.write_batch(pa.record_batch(lists, schema=_schema(self.kind)))

    def close(self) -> None:
        flat = np.concatenate([*self.left, np.array([], self.kind.to_pandas_dtype())])
        for at in range(0, len(flat), BATCH * LENGTH):
            self._put(flat[at : at + BATCH * LENGTH])
        for x in (self.tokens, self.index, *self.sinks):
            x.close()


class PartReader:
    """Random access to the sequences and documents of one part; nothing is copied from a local file."""

    def __init__(self, folder: str, name: str):
        system, path = _files(folder)
        opened = [pa.memory_map(f"{path}/{what}-{name}.arrow") if system.type_name == "local" else
                  system.open_input_file(f"{path}/{what}-{name}.arrow") for what in ("tokens", "index")]
        self.batches = pa.ipc.open_file(opened[0])
        self.index = pa.ipc.open_file(opened[1])

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence i (all batches but the last may have `BATCH` sequences or fewer): tokens and mask."""
        for b in range(self.batches.num_record_batches):
            batch = self.batches.get_batch(b)
            if i < batch.num_rows:
                tokens, mask = (batch.column(c)[i].values for c in ("tokens", "mask"))
                return tokens.to_numpy(), mask.to_numpy(zero_copy_only=False)
            i -= batch.num_rows
        raise IndexError(i)

    def documents(self):
        """(doc_ids, starts, list of the documents' tokens), an index batch at a time, tokens read as they are needed."""
        held, first, b = np.array([], np.uint16), 0, 0  # tokens from place `first` on
        for k in range(self.index.num_record_batches):
            rows = self.index.get_batch(k)
            starts, sizes = (rows.column(c).to_numpy() for c in ("start", "n_tokens"))
            end = int(starts[-1] + sizes[-1]) if len(starts) else first
            parts = [held[int(starts[0]) - first :]] if len(starts) else [held]
            first, have = (int(starts[0]), int(starts[0]) + len(parts[0])) if len(starts) else (first, end)
            while have < end:
                tokens = self.batches.get_batch(b).column("tokens").flatten().to_numpy()
                parts.append(tokens)
                have, b = have + len(tokens), b + 1
            held = np.concatenate(parts) if len(parts) > 1 else parts[0]
            yield rows.column("doc_id").to_pylist(), starts.tolist(), [
                held[s - first : s - first + n] for s, n in zip(starts.tolist(), sizes.tolist())]


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END) -> DataFrame:
    """Write the token ids of all texts of `docs` (doc_id, text) below `folder`; returns the manifest.

    One row per part, in ascending doc_id order (null first, repeated ids by
    text): part, name, documents, tokens.  Each document's ids are followed by
    `end`; a null text has that one only.  Ids take 16 bits if the vocabulary
    allows it, else 32.  Repeated rows are written each; other columns are
    ignored.
    """
    parts = max(1, -(-text_bytes(docs) // PART_BYTES))
    small = max(word_tokens(tokenizer).library.get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16
    kind = pa.uint16() if small else pa.uint32()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        part, writer, name = TaskContext.get().partitionId(), None, ""
        model = word_tokens(tokenizer)
        for batch in slices(batches, 1_024):
            if writer is None:
                name = f"{part:06d}-{uuid.uuid4().hex}"
                writer = PartWriter(folder, name, kind)
            ids, sizes = model.encode_all(batch.column("text"), end)
            writer.add(batch.column("doc_id"), ids.astype(kind.to_pandas_dtype()), sizes)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([writer.documents]),
                                              pa.array([writer.total])], names=["part", "name", "documents", "tokens"])

    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ranged.mapInArrow(run, "part long, name string, documents long, tokens long"), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files of a manifest.

    start counts the ids of all documents before it, padding left out; the
    checksum is over the ids as little-endian 32-bit integers.
    """
    before = F.coalesce(F.sum("tokens").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")  # a row per part
    files = manifest.withColumn("before", before).select("part", "name", "before")

    def run(batches):
        for batch in batches:
            for name, ahead in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist()):
                for doc_ids, starts, documents in PartReader(folder, name).documents():
                    sums = [zlib.crc32(x.astype("<u4")) for x in documents]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc_ids, pa.int64()), pa.array([ahead + s for s in starts], pa.int64()),
                        pa.array([len(x) for x in documents], pa.int64()), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = max(1, manifest.count())
    return files.repartitionByRange(parts, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write `docs` to a new folder below the shared one and read the files back; of an empty table no row comes back."""
    folder = new_folder(spark, "tokens")
    return read(write(docs, folder, tokenizer), folder)
