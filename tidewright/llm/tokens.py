"""Token ids of whole texts by a given tokenizer, and a file format of independent zstandard frames that reads single documents.

Encoding. The tokenizer splits at white space, so the ids of a text are those of its white-space-delimited words in turn. A
worker keeps a table of the words it has met (64-bit hash -> bytes, ids), emptied when it is full, and lets the tokenizers
library encode new words only. Every word is compared with the bytes of the one in the table; words that have another one's
hash are encoded by themselves.

File format. A shard holds documents in ascending doc_id order. The ids, little-endian unsigned 32-bit, are cut at document
ends into blocks of about FRAME_IDS ids; each block is one zstandard frame with a content checksum. A skippable frame with
the document index follows (doc_id, frame, first id in the frame, number of ids, 1 if there is no doc_id; 8 bytes each), then a skippable frame with
the public seek table: for each frame its compressed size, decompressed size and the low 32 bits of the XXH64 of its
decompressed bytes (4 bytes each), and at the very end the number of frames, a flags byte and a magic number. A reader takes
the tail, finds the frames it needs and decompresses no others.

Nulls and empty texts have the end id only; a very long text has a frame of its own. Rows that repeat a doc_id follow each
other, ordered by the hash of their texts, over several shards if they are many. Documents without a doc_id come first. A shard ends
after SHARD_DOCS documents or SHARD_IDS ids; a task writes as many as it takes. An empty table has no shard and gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import materialise, shared_path
from tidewright.llm.words import LOWER, SAME, WHITE, chunks, places, slices, words

#: Ids of a frame, at least; a longer document has a frame of its own.
FRAME_IDS = 1 << 16
#: Documents and ids after which a task begins another shard, so that its index and its read are bounded; documents that a reader gives at once.
SHARD_DOCS, SHARD_IDS, ROWS = 1 << 20, 1 << 28, 1 << 14
#: Words that a worker's table holds, and bytes of them (about 120 MB with the ids).
TABLE_WORDS, TABLE_BYTES = 1_500_000, 32 << 20
#: Magic numbers of zstandard's skippable frames and seek tables.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1

_SEPARATOR = ""


class Encoder:
    """Encodes chunks of texts; one for each tokenizer file and worker process."""

    _open: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = np.array(self._ids([_SEPARATOR])[0], np.uint32)
        # Words that differ in the case of A-Z only have one entry if the tokenizer lowers case itself, but for its special tokens.
        parts = json.loads(self.tokenizer.to_str())
        kinds = parts["normalizer"] or {}
        lowers = any(n["type"] == "Lowercase" for n in kinds.get("normalizers", [kinds]) if n)
        self.lowers, self.special = lowers, [t["content"].lower().encode() for t in parts["added_tokens"]]
        self._empty()

    def _empty(self) -> None:
        self.keys, self.start, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.spell, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.bytes, self.spelled = np.empty(1 << 18, np.uint8), 0

    def _ids(self, some: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _encode(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word): many words at a time, with a separator between them; one by one where a word holds it."""
        between = f" {_SEPARATOR} ".encode()
        flat, counts, n = [], [], len(self.mark)
        for low in range(0, len(new), 500):
            part = new[low : low + 500]
            ids = np.array(self._ids([(between + between.join(part) + between).decode("utf-8", "replace")])[0], np.uint32)
            hit = ids[: len(ids) - n + 1] == self.mark[0]
            for k in range(1, n):
                hit &= ids[k : len(ids) - n + 1 + k] == self.mark[k]
            at = np.flatnonzero(hit)
            if len(at) == len(part) + 1 and (np.diff(at) >= n).all():
                word = np.ones(len(ids), bool)
                for k in range(n):
                    word[at + k] = False
                flat.append(ids[word])
                counts.append(np.diff(at) - n)
            else:
                each = self._ids([w.decode("utf-8", "replace") for w in part])
                flat += [np.array(x, np.uint32) for x in each]
                counts.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(flat), np.concatenate(counts)

    @staticmethod
    def _room(flat: np.ndarray, used: int, more: int) -> np.ndarray:
        return flat if len(flat) >= used + more else np.concatenate([flat[:used], np.empty(used + more, flat.dtype)])

    def _learn(self, hashes: np.ndarray, new: list[bytes], fold: np.ndarray) -> None:
        (more, count), size = self._encode(new), np.array([len(w) for w in new], np.int64)
        spelled = fold[np.frombuffer(b"".join(new), np.uint8)]
        self.flat, self.bytes = self._room(self.flat, self.used, len(more)), self._room(self.bytes, self.spelled, len(spelled))
        self.flat[self.used : self.used + len(more)] = more
        self.bytes[self.spelled : self.spelled + len(spelled)] = spelled
        start, spell = self.used + np.cumsum(count) - count, self.spelled + np.cumsum(size) - size
        self.used, self.spelled = self.used + len(more), self.spelled + len(spelled)
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.start, self.count, self.spell, self.size = (np.insert(a, at, b) for a, b in ((self.keys, hashes), (self.start, start), (self.count, count), (self.spell, spell), (self.size, size)))

    def _strange(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, row: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """The words whose bytes aren't those of the table's word of their hash (its row)."""
        same = size == self.size[row]
        for low, high in slices(size):
            some = np.flatnonzero(same[low:high]) + low
            n = size[some]
            at = places(n)
            differ = fold[data[np.repeat(starts[some], n) + at]] != self.bytes[np.repeat(self.spell[row[some]], n) + at]
            same[np.repeat(some, n)[differ]] = False
        return np.flatnonzero(~same)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i of a chunk has ids[bounds[i]:bounds[i+1]]."""
        raw = data.tobytes()
        low = raw.lower() if self.lowers else b""
        fold = LOWER if self.lowers and not any(t in low for t in self.special) else SAME
        hashes, starts, ends, first = words(data, offsets, WHITE, fold)
        if not len(hashes):
            return np.empty(0, np.uint32), first
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > TABLE_WORDS or self.spelled > TABLE_BYTES:
            self._empty()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            self._learn(distinct[new], [raw[starts[i] : ends[i]] for i in index[new]], fold)
            at = np.searchsorted(self.keys, distinct)
        row = at[inverse]
        start, count, flat = self.start[row], self.count[row].astype(np.int64), self.flat
        if len(strange := self._strange(data, starts, ends - starts, row, fold)):
            ids = [np.array(x, np.uint32) for x in self._ids([data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in strange])]
            count[strange] = [len(x) for x in ids]
            start[strange] = self.used + np.cumsum(count[strange]) - count[strange]
            flat = np.concatenate([flat[: self.used], *ids])
        ends = np.cumsum(count)
        ids = flat[np.arange(ends[-1]) + np.repeat(start - (ends - count), count)]
        return ids, np.concatenate([np.zeros(1, np.int64), ends])[first]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each text's."""
    return np.insert(ids, bounds[1:], end).astype("<u4"), bounds + np.arange(len(bounds))


class _Store:
    """Opens files of the shared folder: a mounted folder, or a store that pyarrow knows by its scheme."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)

    def write(self, name: str, parts: Iterable[bytes]) -> None:
        """Under another name first, so that a task that is lost or runs twice leaves no half a file."""
        self.fs.create_dir(self.root, recursive=True)
        context = TaskContext.get()
        part = f"{self.root}/_{name}.{context.taskAttemptId() if context else 0}"
        with self.fs.open_output_stream(part) as f:
            for x in parts:
                f.write(x)
        self.fs.move(part, f"{self.root}/{name}")

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.root}/{name}")


def write_shard(root: str, name: str, documents: Iterable[tuple[int | None, np.ndarray]]) -> tuple[int, int, int | None]:
    """(documents, ids, first doc_id) of a shard that is written frame by frame; documents come in ascending order, those without a doc_id first."""
    press = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    index, seek, totals = [], [], [0, 0, None]

    def frames() -> Iterator[bytes]:
        held, n = [], 0

        def frame() -> bytes:
            raw = b"".join(held)
            packed = press.compress(raw)
            seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            held.clear()
            return packed

        for doc_id, ids in documents:
            index.append((doc_id or 0, len(seek), n, len(ids), doc_id is None))
            held.append(ids.astype("<u4").tobytes())
            n += len(ids)
            totals[0] += 1
            totals[1] += len(ids)
            totals[2] = doc_id if totals[0] == 1 else totals[2]
            if n >= FRAME_IDS:
                yield frame()
                n = 0
        if held:
            yield frame()
        body = np.array(index, "<i8").reshape(-1, 5).tobytes()
        yield struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body
        table = np.array(seek, "<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(seek), 0x80, SEEK_MAGIC)
        yield struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table

    _Store(root).write(name, frames())
    return tuple(totals)


class Shard:
    """Reads documents of one shard; ``read`` counts the frames it has decompressed."""

    def __init__(self, root: str, name: str):
        self.file, self.read = _Store(root).open(name), 0
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{name} has no seek table")
        tail = 9 + 12 * count
        self.seek = np.frombuffer(self.file.read_at(12 * count, size - tail), "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.seek[:, 0])])
        kind, length = struct.unpack("<II", self.file.read_at(8, int(self.at[-1])))
        if kind != SKIPPABLE_INDEX:
            raise ValueError(f"{name} has no document index")
        self.index = np.frombuffer(self.file.read_at(length, int(self.at[-1]) + 8), "<i8").reshape(-1, 5)
        self.press, self.held = zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            packed = self.file.read_at(int(self.seek[k, 0]), int(self.at[k]))
            try:
                raw = self.press.decompress(packed)
            except zstandard.ZstdError as e:
                raise ValueError(f"frame {k} is damaged") from e
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.held, self.read = (k, np.frombuffer(raw, "<u4")), self.read + 1
        return self.held[1]

    def document(self, row: int) -> np.ndarray:
        _, k, first, n, _ = self.index[row]
        return self.frame(int(k))[first : first + n]

    def find(self, doc_id: int) -> np.ndarray | None:
        """Ids of a document, from its frame alone."""
        unknown = int(self.index[:, 4].sum())
        row = unknown + int(np.searchsorted(self.index[unknown:, 0], doc_id))
        return self.document(row) if row < len(self.index) and self.index[row, 0] == doc_id else None


def shards_of(documents: Iterator[tuple[int | None, np.ndarray]]) -> Iterator[Iterator[tuple[int | None, np.ndarray]]]:
    """The documents of one shard after the other, each of which is to be read to its end."""
    head = next(documents, None)

    def some() -> Iterator[tuple[int | None, np.ndarray]]:
        nonlocal head
        n = ids = 0
        while head is not None and n < SHARD_DOCS and ids < SHARD_IDS:
            now, n, ids = head, n + 1, ids + len(head[1])
            head = next(documents, None)
            yield now

    while head is not None:
        yield some()


def write_tokens(docs: DataFrame, tokenizer: str, root: str, end: int = 2) -> DataFrame:
    """Encodes whole texts and writes shards under root; returns the manifest (name, first_id, n_docs, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.of(tokenizer), TaskContext.get().partitionId()

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for low, high, data, offsets in chunks(batch):
                    flat, bounds = with_end(*encoder.encode(data, offsets), end)
                    for i in range(low, high):
                        yield ids[i], flat[bounds[i - low] : bounds[i - low + 1]]

        for number, some in enumerate(shards_of(documents())):
            name = f"shard-{task:06d}-{number:06d}.tokens.zst"
            n_docs, n_tokens, first = write_shard(root, name, some)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([n_docs]), pa.array([n_tokens])], names=["name", "first_id", "n_docs", "n_tokens"])

    # The hash and a number for each row cut a doc_id that very many rows repeat.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")
    return materialise(ordered.mapInArrow(run, "name string, first_id long, n_docs long, n_tokens long"), "manifest")


def read_tokens(manifest: DataFrame, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the shards, one task for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                shard = Shard(root, name)
                n = shard.index[:, 3]
                start = before + np.cumsum(n) - n
                for low in range(0, len(n), ROWS):
                    rows = slice(low, low + ROWS)
                    crc = [zlib.crc32(shard.document(i).tobytes()) for i in range(low, min(low + ROWS, len(n)))]
                    ids = pa.array(shard.index[rows, 0], mask=shard.index[rows, 4] == 1)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(start[rows]), pa.array(n[rows]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # The manifest has one row for each shard, so its running sum is a small task.
    order = Window.orderBy(F.asc_nulls_first("first_id"), "name").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("name", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))
    return placed.repartition("name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenised(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    root = shared_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer, root, end), root)
