"""Record files as a Spark data source: byte ranges cut at records, written with commit and abort.

``format("records")`` reads and writes one binary column ``record``; decoding stays with
the native expressions of :mod:`claimweave.sources.records`. Paths may have any scheme
that Arrow opens (local, HDFS, S3, GCS). Workers need no copy of this package: the
source's classes are sent to them.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from claimweave.sources.layouts import Layout
from claimweave.sources.records import decode_records, encode_records

_BATCH = 4 << 20  # bytes read at once


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int]]:
    """Files of a path and their sizes, by name; names that start with ``_`` or ``.`` are not data."""
    from pyarrow import fs

    system, inside = _open(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [(inside, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inside))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def check_sizes(files: list[tuple[str, int]], length: int) -> None:
    for path, size in files:
        if size % length:
            raise ValueError(f"{path}: {size} bytes is not a whole number of {length}-byte records")


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, length: int, delimiter: bytes, trailer: int, range_bytes: int):
        self.path, self.length, self.delimiter, self.trailer = path, length, delimiter, trailer
        self.step = length + trailer
        self.range_bytes = max(1, range_bytes // self.step) * self.step

    def partitions(self) -> list[ByteRange]:
        files = list_files(self.path)
        check_sizes(files, self.step)
        ranges = [ByteRange(path, at, min(at + self.range_bytes, size)) for path, size in files for at in range(0, size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        system = _open(self.path)[0]
        with system.open_input_file(partition.path) as file:
            file.seek(partition.start)
            at, chunk = partition.start, max(1, _BATCH // self.step) * self.step
            while at < partition.end:
                data = file.read(min(chunk, partition.end - at))
                if len(data) % self.step or not data:
                    raise ValueError(f"{partition.path}: cut short at byte {at + len(data)}")
                rows = np.frombuffer(data, np.uint8).reshape(-1, self.step)
                if self.delimiter:
                    wrong = (rows[:, self.length:] != np.frombuffer(self.delimiter, np.uint8)).any(axis=1)
                    if wrong.any():
                        raise ValueError(f"{partition.path}: no delimiter {self.delimiter!r} after the record at byte {at + int(wrong.argmax()) * self.step}")
                kept = np.ascontiguousarray(rows[:, :self.length])
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.length), len(rows), [None, pa.py_buffer(kept)])
                yield pa.RecordBatch.from_arrays([fixed.cast(pa.binary())], names=["record"])
                at += len(data)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str
    records: int


class _Writer(DataSourceArrowWriter):
    """A task writes to a hidden file; only the commit of the whole job gives the files their names."""

    def __init__(self, path: str, length: int, delimiter: bytes, overwrite: bool):
        self.path, self.length, self.delimiter, self.overwrite, self.job = path, length, delimiter, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, inside = _open(self.path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.job}.dat"
        temporary, n = f"{inside}/.{name}.{context.taskAttemptId()}", 0
        system.create_dir(inside, recursive=True)
        with system.open_output_stream(temporary) as out:
            for batch in batches:
                records = batch.column(0)
                sizes = pa.compute.binary_length(records)
                if records.null_count or set(sizes.unique().to_pylist()) - {self.length}:
                    raise ValueError(f"records of {sizes.unique().to_pylist()} bytes, not {self.length}")
                fixed = records.cast(pa.binary(self.length))
                start = fixed.offset * self.length
                rows = np.frombuffer(fixed.buffers()[1], np.uint8, len(fixed) * self.length, start).reshape(-1, self.length) if len(fixed) else None
                if rows is not None:
                    ends = np.broadcast_to(np.frombuffer(self.delimiter, np.uint8), (len(rows), len(self.delimiter)))
                    out.write(np.concatenate([rows, ends], axis=1).tobytes())
                n += len(fixed)
        return Written(temporary, f"{inside}/{name}", n)

    def commit(self, messages: list[Written | None]) -> None:
        system, inside = _open(self.path)
        system.create_dir(inside, recursive=True)
        old = [path for path, _ in list_files(self.path)] if self.overwrite else []
        for message in messages:
            if message is not None and message.records:
                system.move(message.temporary, message.final)
            elif message is not None:
                system.delete_file(message.temporary)
        for path in old:
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        """Removes whatever tasks of this job left, also those that failed midway."""
        from pyarrow import fs

        system, inside = _open(self.path)
        for info in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
            if self.job in info.base_name:
                system.delete_file(info.path)


class RecordSource(DataSource):
    """Options: ``path``, ``length`` of a record, ``delimiter`` after each (hexadecimal, checked) or
    ``trailer`` (a number of bytes, skipped), ``rangeBytes`` of a partition."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "record binary"

    def _of(self) -> tuple[str, int, bytes]:
        return self.options["path"], int(self.options["length"]), bytes.fromhex(self.options.get("delimiter", ""))

    def reader(self, schema) -> _Reader:
        path, length, delimiter = self._of()
        return _Reader(path, length, delimiter, len(delimiter) or int(self.options.get("trailer", 0)), int(self.options.get("rangeBytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(*self._of(), overwrite)


def _registered(spark: SparkSession) -> None:
    register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(RecordSource)


def read_records(spark: SparkSession, path: str, layout: Layout, packed: bool, delimiter: bytes = b"", trailer: int = 0,
                 bad: str | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """Typed rows of a record file or a folder of them.

    Files are cut into ranges of whole records, so a packed byte may equal CR or LF. A file
    whose size is no whole number of records raises before anything is read, a wrong
    ``delimiter`` while reading; a ``trailer`` is skipped unseen. A folder without files has no rows.
    """
    length = layout.length(packed)
    check_sizes(list_files(path), length + (len(delimiter) or trailer))
    _registered(spark)
    rows = (
        spark.read.format("records").option("length", length).option("delimiter", delimiter.hex())
        .option("trailer", trailer).option("rangeBytes", range_bytes).load(path)
    )
    return decode_records(rows, "record", layout, packed, bad)


def write_records(df: DataFrame, path: str, layout: Layout, packed: bool, delimiter: bytes = b"", mode: str = "overwrite") -> None:
    """Rows as record files under ``path``, a file a task. Readers see the files when all are
    written; a failing job leaves what was there. ``mode`` is overwrite or append."""
    _registered(df.sparkSession)
    encoded = encode_records(df, layout, packed)
    encoded.write.format("records").mode(mode).option("length", layout.length(packed)).option("delimiter", delimiter.hex()).save(path)


def read_packed(spark: SparkSession, path: str, layout: Layout, trailer: int = 0, bad: str | None = None) -> DataFrame:
    """Records with packed decimals; ``trailer`` bytes after each are skipped."""
    return read_records(spark, path, layout, True, trailer=trailer, bad=bad)
