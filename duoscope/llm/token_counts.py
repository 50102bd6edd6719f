"""Token counts as delta-maintained rollups by source, language and tokenizer version.

Changes come as signed rows (sign, source, lang, version, tokens): an insert is +1, a delete -1 with what the row had,
a revised count is the old row at -1 and the new one at +1. A batch is summed to one row a key and written to a
folder of its own; it counts from the moment that its marker, a file named by the batch id and created only if there
is none, names that folder. Of several writers of one batch one gets the marker, the others are told so; replays and
retries count once. Totals are the sums of the folders that markers name. compact() sums them once more to a base that
lists the batches it holds, so that reads stay as small as the keys are few; totals are the same before and after.

Sums are partially aggregated in each task before they are shuffled, so a source with a third of all rows is a few
rows. Executors may be lost at any time: what an unfinished write leaves is named by no marker.

Defined results: a null source or language is its own key; a null or empty text has 0 tokens and counts as a document;
a batch of no rows is committed and changes nothing; keys whose documents and tokens are both 0 are left out of totals.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import bpe, token_files
from .textblocks import blocks

KEYS = ("source", "lang", "version")
_SCHEMA = "source string, lang string, version string, documents long, tokens long"


def words(text: Column) -> Column:
    """Version words-1: runs of characters between blanks."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def byte_quads(text: Column) -> Column:
    """A first estimate of any tokenizer's count: UTF-8 bytes by four, rounded up."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def tokenized(df: DataFrame, tokenizers: dict[str, str], text: str = "text") -> DataFrame:
    """df without the text, with the number of tokens by each tokenizer: {column: path of a .tiktoken or .json file}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [bpe.codec(p).cache if p.endswith(".tiktoken") else token_files.encoder(p) for p in tokenizers.values()]
        for batch in batches:
            counts = [[np.zeros(0, np.int64)] for _ in own]
            for b in blocks(batch.column(text)):
                for c, coder in zip(counts, own):
                    c.append(np.diff(coder.block(b)[1]))
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.concatenate(c), pa.int64()) for c in counts)], [*names, *tokenizers])

    names = [c for c in df.columns if c != text]
    if clash := {c.lower() for c in names} & {c.lower() for c in tokenizers}:
        raise ValueError(f"the input already has columns {sorted(clash)}")
    ship(df.sparkSession)
    schema = df.select(*names).schema
    for c in tokenizers:
        schema = schema.add(c, "long")
    return df.mapInArrow(run, schema)


class Rollup:
    """Totals below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, top: str) -> list[str]:
        fs, path = self._fs(), self._path(top)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _content(self, name: str) -> str:
        fs, path = self._fs(), self._path(name)
        size = fs.getFileStatus(path).getLen()
        if not size:
            return ""
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, name: str, content: str) -> bool:
        """Creates a marker, unless there is one; an empty one is of a writer that died before it said anything."""
        fs, path = self._fs(), self._path(name)
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            if self._content(name):
                return False
            out = fs.create(path, True)
        out.writeBytes(content)
        out.close()
        return self._content(name) == content

    def _folders(self) -> dict[str, str]:
        """Folder of each committed batch."""
        found = {b: self._content(f"commits/{b}") for b in self._names("commits")}
        return {b: f for b, f in found.items() if f}

    def _base(self) -> tuple[int, str | None, list[str]]:
        """Number, folder and batches of the last compaction."""
        for name in reversed(self._names("bases")):
            if content := self._content(f"bases/{name}"):
                got = json.loads(content)
                return int(name), got["folder"], got["batches"]
        return 0, None, []

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return sorted(self._folders())

    def _write(self, sums: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.folder}/{folder}")
        return folder

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch of signed changes once; returns whether this call applied it."""
        if not batch or "/" in batch or batch[0] in "._":
            raise ValueError("a batch id is a plain name")
        if batch in self._folders():
            return False
        if changes.filter("sign is null or sign not in (-1, 1)").limit(1).count():
            raise ValueError("a sign is 1 or -1")
        folder = self._write(changes.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("documents"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens")))
        if self._publish(f"commits/{batch}", folder):
            return True
        self._fs().delete(self._path(folder), True)  # another writer was first
        return False

    def _sums(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(_SCHEMA).parquet(*(f"{self.folder}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def _current(self) -> tuple[list[str], list[str], int]:
        """(folders that make up the totals, batches in them, number of the last base)."""
        committed, (number, base, held) = self._folders(), self._base()
        return [*([base] if base else []), *(f for b, f in sorted(committed.items()) if b not in set(held))], sorted(committed), number

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens over all committed batches."""
        return self._sums(self._current()[0]).filter("documents <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """Sums all committed batches to a new base; returns whether this call's base counts."""
        folders, held, number = self._current()
        folder = self._write(self._sums(folders))
        if self._publish(f"bases/{number + 1:08d}", json.dumps({"folder": folder, "batches": held})):
            return True
        self._fs().delete(self._path(folder), True)
        return False


def changed(counts: DataFrame, version: str, tokens: str, sign: int = 1) -> DataFrame:
    """Signed changes from a table with source and lang."""
    return counts.select(F.lit(sign).alias("sign"), "source", "lang", F.lit(version).alias("version"), F.col(tokens).alias("tokens"))


def maintained(df: DataFrame, folder: str, tokenizers: dict[str, str], short: int = 5) -> DataFrame:
    """Totals of a corpus after its life: for each tokenizer version all documents are inserted with an estimate that is
    then revised to the tokenizer's count; documents of under `short` words are deleted, and inserted again. Two of the
    batches are sent again, and the batches so far are compacted. So the totals are those of all documents."""
    spark = df.sparkSession
    rollup = Rollup(spark, folder)
    texts = df.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"))
    named = {f"count{i}": p for i, p in enumerate(tokenizers.values())}
    counts = tokenized(texts.withColumns({"words": words(F.col("text")), "quads": byte_quads(F.col("text"))}), named)
    path = f"{rollup.folder}/counts"
    counts.write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    gone = counts.filter(F.col("words") < short)
    for version, column in [("words-1", "words"), *zip(tokenizers, named)]:
        feed = {f"{version}-1-insert": changed(counts, version, column if column == "words" else "quads")}
        if column != "words":
            feed[f"{version}-2-revise"] = changed(counts, version, "quads", -1).union(changed(counts, version, column))
        feed[f"{version}-3-delete"] = changed(gone, version, column, -1)
        feed[f"{version}-4-return"] = changed(gone, version, column)
        for name in (*feed, f"{version}-3-delete", f"{version}-1-insert"):
            rollup.commit(name, feed[name])
        rollup.compact()
    return rollup.totals()
