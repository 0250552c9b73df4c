"""Files in IDX format as a Spark data source: big-endian magic number and sizes, then numbers in a row.

    spark.dataSource.register(IdxSource)
    spark.read.format("idx").option("type", "u8").load(path)      # id long, v array<double>
    df.write.format("idx").mode("append").save(path)               # v as unsigned bytes, several files

A path is a file, or a folder whose files follow one another in order of their names; ids are places in all of them.
Files are cut into ranges of rows, each read by a task of its own, through a file system that pyarrow knows by the path.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# --- fixed values: the third byte of the magic number, the names of types, and their numpy forms ---
TYPES = {0x08: ("u8", ">u1"), 0x09: ("i8", ">i1"), 0x0B: ("i16", ">i2"), 0x0C: ("i32", ">i4"), 0x0D: ("f32", ">f4"), 0x0E: ("f64", ">f8")}
#: Bytes of a range of rows, and of a file that is written, at most; rows of an Arrow batch.
RANGE, BATCH = 64 << 20, 4096


@dataclass(frozen=True)
class Header:
    path: str
    kind: str
    sizes: tuple[int, ...]

    @property
    def start(self) -> int:
        return 4 + 4 * len(self.sizes)

    @property
    def width(self) -> int:
        return int(np.prod(self.sizes[1:], dtype=np.int64))

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.kind).itemsize


@dataclass
class Rows(InputPartition):
    header: Header
    first: int
    count: int
    id: int


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"there is no {path}")
    if info.type == fs.FileType.File:
        return system, [info]
    found = system.get_file_info(fs.FileSelector(inner))
    return system, sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)


def header(system: fs.FileSystem, file: fs.FileInfo, kind: str | None) -> Header:
    """The checked header of a file: raises for another magic number, another type than asked for, or a length that doesn't fit."""
    with system.open_input_file(file.path) as f:
        magic = f.read(4)
        if len(magic) < 4 or magic[:2] != b"\0\0" or magic[2] not in TYPES or not magic[3]:
            raise ValueError(f"not an IDX file: {file.path}")
        name, form = TYPES[magic[2]]
        if kind and kind != name:
            raise ValueError(f"the IDX file holds {name}, not {kind}: {file.path}")
        sizes = f.read(4 * magic[3])
    if len(sizes) < 4 * magic[3]:
        raise ValueError(f"the IDX file's length doesn't fit its sizes: {file.path}")
    found = Header(file.path, form, tuple(int(x) for x in np.frombuffer(sizes, ">u4")))
    if file.size != found.start + found.sizes[0] * found.row_bytes:
        raise ValueError(f"the IDX file's length doesn't fit its sizes: {file.path}")
    return found


class IdxSource(DataSource):
    """Options: path, type (checked if given), range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "idx"

    def schema(self) -> str:
        return "id long, v array<double>"

    def reader(self, schema) -> IdxReader:
        return IdxReader(self.options)

    def writer(self, schema, overwrite: bool) -> IdxWriter:
        if overwrite:
            raise ValueError("an IDX folder is only appended to")
        if "v" not in schema.names:
            raise ValueError("a column v is written")
        return IdxWriter(self.options, schema.names.index("v"))


class IdxReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind, self.range = options["path"], options.get("type"), int(options.get("range_bytes", RANGE))

    def partitions(self) -> list[Rows]:
        """Ranges of rows of every file; only headers are read for them."""
        system, files = _files(self.path)
        found, at = [], 0
        for one in (header(system, f, self.kind) for f in files):
            if found and one.width != found[0].header.width:
                raise ValueError(f"vectors differ in length: {one.path}")
            rows = max(1, self.range // max(1, one.row_bytes))
            found += [Rows(one, k, min(rows, one.sizes[0] - k), at + k) for k in range(0, one.sizes[0], rows)]
            at += one.sizes[0]
        return found or [Rows(Header("", ">u1", (0,)), 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        own = partition.header
        if not partition.count:
            return
        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else "file://" + self.path)
        with system.open_input_file(own.path) as f:
            f.seek(own.start + partition.first * own.row_bytes)
            for k in range(0, partition.count, BATCH):
                rows = min(BATCH, partition.count - k)
                data = np.frombuffer(f.read(rows * own.row_bytes), own.kind).astype(np.float64)
                ends = np.arange(rows + 1, dtype=np.int32) * own.width
                yield pa.record_batch([pa.array(np.arange(rows) + partition.id + k), pa.ListArray.from_arrays(pa.array(ends), pa.array(data))], names=["id", "v"])


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class IdxWriter(DataSourceWriter):
    """Each task writes files of its own below a temporary folder; what was committed moves to the path in the end."""

    def __init__(self, options, column: int):
        self.path, self.column, self.range = options["path"], column, int(options.get("range_bytes", RANGE))
        self.run = uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str]:
        system, inner = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else "file://" + self.path)
        return system, inner

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, inner = self._place()
        folder = f"{inner}/_temporary-{self.run}"
        system.create_dir(folder, recursive=True)
        names, held, width = [], [], None

        def close() -> None:
            data = np.array(held, np.float64)
            if not (np.isfinite(data).all() and (data == np.floor(data)).all() and (data >= 0).all() and (data < 256).all()):
                raise ValueError("unsigned bytes are written: other values don't fit")
            names.append(f"part-{context.partitionId():06d}-{len(names):06d}-{context.taskAttemptId()}.idx")
            with system.open_output_stream(f"{folder}/{names[-1]}") as f:
                f.write(b"\0\0\x08\x02" + np.array(data.shape, ">u4").tobytes() + data.astype(np.uint8).tobytes())
            held.clear()

        for row in rows:
            v = row[self.column]
            width = len(v) if v is not None and width is None else width
            if v is None or len(v) != width:
                raise ValueError("vectors are null or differ in length: validate the points first")
            held.append(v)
            if len(held) * width >= self.range:
                close()
        if held:
            close()
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = self._place()
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{inner}/_temporary-{self.run}/{name}", f"{inner}/{name}")
        self._clear(system, inner)

    def abort(self, messages) -> None:
        self._clear(*self._place())

    def _clear(self, system: fs.FileSystem, inner: str) -> None:
        if system.get_file_info(f"{inner}/_temporary-{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/_temporary-{self.run}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IdxSource)
