"""Token ids in Arrow IPC files of fixed-size-list batches: equal-length sequences and masks, read without copies.

Documents go in ascending key order: a range partition, a sort within it, one file a partition. A file holds
`ids fixed_size_list<uint16 or uint32>[length]` and `mask fixed_size_list<bool>[length]`; documents follow one
another across sequences, and only the last sequence of a file is padded (mask false). An index file beside it has
each document's key, first token in the file and number of tokens. Files have the name of the attempt that wrote them
and are never moved; the manifest, a table below the folder that is written last, lists those of the attempts that
counted. So a retried or speculative task leaves files that nothing names, and data and index are of one attempt. Files
are read by a memory map where the file system is a local one.

Defined results: a null or empty text is its end id alone; equal keys keep both rows, in either order; null keys
come first; an empty table gives no documents; the literal of an added token in a text is that token, as it is by the
library's default. Other columns are not stored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .storage import scratch
from .textblocks import Block, PieceCache, blocks

SEQUENCE = 2048
SEQUENCES_A_BATCH = 64


class LibraryEncoder:
    """Ids by the tokenizers library. A plain byte-level model is asked for each distinct piece once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        before = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if self.by_piece:
            from tokenizers.pre_tokenizers import ByteLevel

            self.model = self.tokenizer.model
            plain = ByteLevel(add_prefix_space=False, use_regex=False)
            # the library's own letter for each byte: ASCII directly, the others by two-byte characters that hold them
            letters = {b: plain.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
            for c in range(128, 0x800):
                for b, letter in zip(chr(c).encode(), plain.pre_tokenize_str(chr(c))[0][0]):
                    letters.setdefault(b, letter)
            for c in (*range(0x1000, 0x10000, 0x1000), *range(0x10000, 0x110000, 0x10000)):
                if c != 0xD000:
                    for b, letter in zip(chr(c).encode(), plain.pre_tokenize_str(chr(c))[0][0]):
                        letters.setdefault(b, letter)
            self.letters = str.maketrans({chr(b): x for b, x in letters.items()})
            self.cache = PieceCache(self._pieces)

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, letters = self.model.tokenize, self.letters
        found = [[t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))] for w in words]
        return np.array([i for ids in found for i in ids], np.int32), np.array([len(x) for x in found], np.int64)

    def block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        at = block.offsets.tolist()
        if self.by_piece:
            ids, offsets = self.cache.block(block)
            if not any(t in block.text for t in self.added):
                return ids, offsets
            parts = np.split(ids, offsets[1:-1])
            for i, (a, b) in enumerate(zip(at, at[1:])):
                if any(t in block.text[a:b] for t in self.added):  # the library splits the text at them
                    parts[i] = np.array(self.tokenizer.encode(block.text[a:b], add_special_tokens=False).ids, np.int32)
            return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int64)
        found = [e.ids for e in self.tokenizer.encode_batch([block.text[a:b] for a, b in zip(at, at[1:])], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.int32), np.append(0, np.cumsum([len(x) for x in found])).astype(np.int64)


@lru_cache(2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' ids with `end` after each row."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.int32)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(ids)) + rows] = ids
    return out, offsets + np.arange(n + 1)


class SequenceWriter:
    """Writes ids as they come; holds less than one batch of sequences."""

    def __init__(self, sink, dtype: np.dtype, length: int = SEQUENCE):
        self.length, self.dtype, self.rest, self.written = length, dtype, np.zeros(0, dtype), 0
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)

    def _batch(self, values: np.ndarray, real: int) -> None:
        mask = np.ones(len(values), bool)
        mask[real:] = False
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.written += len(ids)
        values, size = np.concatenate([self.rest, ids.astype(self.dtype)]), self.length * SEQUENCES_A_BATCH
        whole = len(values) // size * size
        for at in range(0, whole, size):
            self._batch(values[at : at + size], size)
        self.rest = values[whole:]

    def close(self) -> None:
        if len(self.rest):
            real = len(self.rest)
            self._batch(np.concatenate([self.rest, np.zeros(-real % self.length, self.dtype)]), real)
        self.out.close()


class SequenceReader:
    """Random access to the tokens of one file; every batch but the last has SEQUENCES_A_BATCH sequences."""

    def __init__(self, source, length: int = SEQUENCE):
        self.file, self.size = pa.ipc.open_file(source), length * SEQUENCES_A_BATCH
        self.at, self.values, self.mask = -1, np.zeros(0), np.zeros(0, bool)

    def _load(self, i: int) -> None:
        if i != self.at:
            batch = self.file.get_batch(i)
            self.at, self.values = i, batch.column("ids").flatten().to_numpy()
            self.mask = batch.column("mask").flatten().to_numpy(zero_copy_only=False)

    def ids(self, start: int, count: int) -> np.ndarray:
        parts = []
        while count:
            self._load(start // self.size)
            lo = start % self.size
            n = min(count, self.size - lo)
            if not self.mask[lo : lo + n].all():
                raise ValueError("tokens asked for beyond the mask")
            parts.append(self.values[lo : lo + n])
            start, count = start + n, count - n
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


MANIFEST = "part long, path string, documents long, tokens long"
INDEX = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write(df: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end: int = 2) -> list[tuple[int, str, int, int]]:
    """Writes the files of all documents; returns (part, path, documents, tokens) of each file, one row a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}"
        documents = 0
        with fs.open_output_stream(f"{name}.arrow") as sink, fs.open_output_stream(f"{name}.index") as beside:
            out = SequenceWriter(sink, np.dtype(np.uint16 if max(own.size, end + 1) <= 1 << 16 else np.uint32))
            with pa.ipc.new_file(beside, INDEX) as index:
                for batch in batches:
                    keys = batch.column(0)
                    for b in blocks(batch.column(1)):
                        ids, offsets = with_end(*own.block(b), end)
                        rows = [keys.slice(b.lo, b.hi - b.lo), pa.array(offsets[:-1] + out.written), pa.array(np.diff(offsets))]
                        index.write_batch(pa.RecordBatch.from_arrays(rows, schema=INDEX))
                        out.add(ids)
                        documents += b.hi - b.lo
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([documents]), pa.array([out.written])], ["part", "path", "documents", "tokens"])

    ship(df.sparkSession)
    ordered = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key")
    files = sorted(tuple(r) for r in ordered.mapInArrow(run, MANIFEST).collect())  # a row a file
    df.sparkSession.createDataFrame(files, MANIFEST).coalesce(1).write.json(f"{folder.rstrip('/')}/manifest")
    return files


def manifest(spark: SparkSession, folder: str) -> list[tuple[int, str, int, int]]:
    """What write() returned."""
    return sorted(tuple(r) for r in spark.read.schema(MANIFEST).json(f"{folder.rstrip('/')}/manifest").collect())


def opened(fs: pafs.FileSystem, path: str):
    """A file for random access."""
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


def read(spark: SparkSession, folder: str, files: list[tuple[int, str, int, int]] | None = None, key: str = "doc_id") -> DataFrame:
    """Per document of the files (those of the manifest): key, start (tokens of all documents before it), n_tokens, ids_crc32."""
    files = manifest(spark, folder) if files is None else files
    begin, rows = 0, []
    for part, path, documents, tokens in files:
        if documents:
            rows.append((part, path, begin))
        begin += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("begin").to_pylist()):
                with opened(fs, f"{path}.index") as beside, opened(fs, f"{path}.arrow") as source:
                    tokens, index = SequenceReader(source), pa.ipc.open_file(beside)
                    for i in range(index.num_record_batches):
                        part = index.get_batch(i)
                        starts, counts = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                        sums = [zlib.crc32(tokens.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist())]
                        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(starts + first), part.column("n_tokens"), pa.array(sums, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([T.StructField(key, T.LongType()), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
    if not rows:
        return spark.createDataFrame([], schema)
    ship(spark)
    listed = spark.createDataFrame(rows, "part long, path string, begin long")
    return listed.repartitionByRange(len(rows), "part").mapInArrow(run, schema)


def store(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 2, folder: str | None = None) -> DataFrame:
    """Writes all documents' ids and returns what read() finds in the files."""
    spark = df.sparkSession
    folder = folder or scratch(spark, "tokens")
    return read(spark, folder, write(df, tokenizer, folder, key, text, end), key)
