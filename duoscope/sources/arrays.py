"""`.npy` matrices as a Spark data source: read by ranges of rows, written by tasks.

Reading: a file's header says where its numbers are; a partition seeks to its range of rows and reads no other bytes (of a matrix
in column order only those of its columns, too). A folder is a matrix of several files, in the order of its manifest. Rows are
(key, columns); the option `columns` reads some of them only, and predicates on the key that Spark pushes down drop ranges.

Writing: every task writes its rows to a file of its own, and the driver, when all have ended well, the manifest with the files of
the attempts that counted, in the order of partitions, and their rows. A retried task leaves a file that nothing names; an
aborted write removes what it knows of. Each file is a plain `.npy`, and no task holds more than CHUNK rows of it.

Paths are those that pyarrow's file systems know (local, hdfs, s3, gs); null numbers are written as NaN.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..runtime import ship

RANGE_BYTES = 64 << 20
CHUNK = 16_384
MANIFEST = "manifest.json"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Header:
    """What a file says of its numbers."""

    path: str
    rows: int
    width: int
    dtype: str
    by_column: bool
    start: int
    first: int = 0  # the file's first row in the matrix


def header(path: str, first: int = 0) -> Header:
    fs, inner = place(path)
    with fs.open_input_file(inner) as f:
        head = io.BytesIO(f.read(1 << 16))
    version = np.lib.format.read_magic(head)
    shape, by_column, dtype = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version](head)
    if dtype.hasobject or not len(shape):
        raise ValueError(f"{path} holds no matrix of numbers")
    return Header(path, shape[0], int(np.prod(shape[1:], dtype=int)), dtype.str, by_column and len(shape) > 1, head.tell(), first)


def headers(path: str) -> list[Header]:
    """Of a file, or of all files of a folder in the order of its manifest."""
    fs, inner = place(path)
    if fs.get_file_info(inner).type != pafs.FileType.Directory:
        return [header(path)]
    with fs.open_input_file(f"{inner}/{MANIFEST}") as f:
        parts = json.loads(f.read())["files"]
    out, first = [], 0
    for part in parts:
        found = header(f"{path.rstrip('/')}/{part['file']}", first)
        if found.rows != part["rows"]:
            raise ValueError(f"{found.path} has {found.rows} rows, not {part['rows']}")
        out.append(found)
        first += found.rows
    return out


@dataclass
class Range(InputPartition):
    """Some rows of a file."""

    of: Header
    lo: int
    hi: int


class NpyReader(DataSourceReader):
    def __init__(self, path: str, key: str, names: list[str], wanted: list[int], range_bytes: int):
        self.path, self.key, self.names, self.wanted, self.range_bytes = path, key, names, wanted, range_bytes
        self.low, self.high = 0, 1 << 62  # rows that the filters leave

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (self.key,) and isinstance(f.value, int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for h in headers(self.path):
            step = max(1, self.range_bytes // max(1, h.width * np.dtype(h.dtype).itemsize))
            lo, hi = max(0, self.low - h.first), min(h.rows, self.high - h.first)
            out += [Range(h, a, min(a + step, hi)) for a in range(lo, hi, step)]
        return out or [Range(Header(self.path, 0, 0, "<f8", False, 0), 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        h, item = part.of, np.dtype(part.of.dtype)
        if part.hi <= part.lo:
            return
        fs, inner = place(h.path)
        with fs.open_input_file(inner) as f:

            def numbers(at: int, n: int) -> np.ndarray:
                f.seek(h.start + at * item.itemsize)
                raw = f.read(n * item.itemsize)
                if len(raw) != n * item.itemsize:
                    raise ValueError(f"{h.path} ends too soon")
                return np.frombuffer(raw, item)

            for lo in range(part.lo, part.hi, CHUNK):
                hi = min(lo + CHUNK, part.hi)
                if h.by_column:
                    columns = [numbers(c * h.rows + lo, hi - lo) for c in self.wanted]
                else:
                    rows = numbers(lo * h.width, (hi - lo) * h.width).reshape(hi - lo, h.width)
                    columns = [rows[:, c] for c in self.wanted]
                ids = np.arange(h.first + lo, h.first + hi)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c.astype(np.float64)) for c in columns)], [self.key, *self.names])


@dataclass
class Written(WriterCommitMessage):
    """A task's file and its rows."""

    partition: int
    file: str
    rows: int


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], dtype: str, overwrite: bool):
        self.path, self.names, self.dtype = path.rstrip("/"), names, np.dtype(dtype)
        fs, inner = place(self.path)
        known = fs.get_file_info(f"{inner}/{MANIFEST}").type != pafs.FileType.NotFound
        if known and not overwrite:
            raise ValueError(f"{path} is there already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, inner = place(self.path)
        fs.create_dir(inner, recursive=True)
        partition = TaskContext.get().partitionId()
        name, rows = f"part-{partition:05d}-{uuid.uuid4().hex}.npy", 0
        body = f"{inner}/{name}.body"
        with fs.open_output_stream(body) as out:
            for batch in iterator:
                columns = [batch.column(n).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for n in self.names]
                out.write(np.stack(columns, 1).astype(self.dtype).tobytes())
                rows += batch.num_rows
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": self.dtype.str, "fortran_order": False, "shape": (rows, len(self.names))})
        with fs.open_output_stream(f"{inner}/{name}") as out, fs.open_input_stream(body) as numbers:  # the header has the number of rows
            out.write(head.getvalue())
            while some := numbers.read(1 << 20):
                out.write(some)
        fs.delete_file(body)
        return Written(partition, name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, inner = place(self.path)
        files = [{"file": m.file, "rows": m.rows} for m in sorted((m for m in messages if m), key=lambda m: m.partition) if m.rows]
        told = {"files": files, "rows": sum(f["rows"] for f in files), "columns": self.names, "dtype": self.dtype.str}
        fs.create_dir(inner, recursive=True)
        with fs.open_output_stream(f"{inner}/{MANIFEST}") as out:
            out.write(json.dumps(told, indent=1).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, inner = place(self.path)
        for m in messages:
            if m and fs.get_file_info(f"{inner}/{m.file}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{inner}/{m.file}")


class NpySource(DataSource):
    """format("npy"): options path, key (idx), names (of all columns), columns (to read), dtype (to write), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _key(self) -> str:
        return self.options.get("key", "idx")

    def _names(self) -> list[str]:
        path = self.options["path"]
        fs, inner = place(path)
        names = [n for n in self.options.get("names", "").split(",") if n]
        if not names and fs.get_file_info(inner).type == pafs.FileType.Directory:
            with fs.open_input_file(f"{inner}/{MANIFEST}") as f:
                return json.loads(f.read())["columns"]
        width = headers(path)[0].width
        if names and len(names) != width:
            raise ValueError(f"{path} has {width} columns, not {len(names)}")
        return names or [f"x{i}" for i in range(width)]

    def _wanted(self) -> list[str]:
        names = self._names()
        wanted = [n for n in self.options.get("columns", "").split(",") if n] or names
        if unknown := [n for n in wanted if n not in names]:
            raise ValueError(f"no columns {', '.join(unknown)} in {self.options['path']}")
        return wanted

    def schema(self) -> str:
        return ", ".join([f"`{self._key()}` bigint", *(f"`{n}` double" for n in self._wanted())])

    def reader(self, schema: StructType) -> NpyReader:
        names, wanted = self._names(), self._wanted()
        return NpyReader(self.options["path"], self._key(), wanted, [names.index(n) for n in wanted], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], [f.name for f in schema.fields], self.options.get("dtype", "<f4"), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpySource)


def read_npy(spark: SparkSession, path: str, names: Sequence[str] = (), columns: Sequence[str] = (), key: str = "idx") -> DataFrame:
    """(key, columns) of a matrix, whose key is the number of its row."""
    register(spark)
    return spark.read.format("npy").options(key=key, names=",".join(names), columns=",".join(columns)).load(path)


def write_npy(df: DataFrame, path: str, key: str, columns: Sequence[str], dtype: str = "<f4", mode: str = "append") -> None:
    """The columns in the order of the key, as a folder of files; mode "append" refuses a folder that has a matrix, "overwrite" replaces it."""
    register(df.sparkSession)
    ordered = df.repartitionByRange(key).sortWithinPartitions(key).select(*(df[c].cast("double") for c in columns))
    ordered.write.format("npy").option("dtype", dtype).mode(mode).save(path)
