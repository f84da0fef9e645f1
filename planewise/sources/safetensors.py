"""Checkpoint files as tables of tensors.

``register(spark)`` adds the format ``safetensors``: one row a tensor, with
filters on ``name`` pushed into the scan and only the wanted byte ranges read; it needs paths that the executors can
open.  ``read_checkpoints`` reads the same rows through Spark's own file reader, from any store.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from planewise.functions.checkpoint import CONTAINER, _parse_header, build_safetensors, decompress_checkpoint, parse_safetensors

SCHEMA = "path string, ordinal int, name string, dtype string, shape array<long>, begin long, end long, raw binary"


class _Part(InputPartition):
    def __init__(self, path: str, rows: list[tuple], start: int):
        self.path, self.rows, self.start = path, rows, start


class _Reader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("name",):
                self.names = values if self.names is None else self.names & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Headers only are read here; tensors are grouped to parts of about ``part_bytes``."""
        files = sorted(glob.glob(os.path.join(self.path, "*.safetensors"))) if os.path.isdir(self.path) else [self.path]
        parts: list[InputPartition] = []
        for path in files:
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                n = struct.unpack("<Q", f.read(8))[0]
                if n > size - 8:
                    raise ValueError("the header reaches beyond the file")
                _, tensors, _, start = _parse_header(f.read(n), size - 8 - n)
            rows, held = [], 0
            for i, t in enumerate(tensors):
                if self.names is not None and t.name not in self.names:
                    continue
                rows.append((i, t.name, t.dtype, list(t.shape), t.begin, t.end))
                held += t.end - t.begin
                if held >= self.part_bytes:
                    parts.append(_Part(path, rows, start))
                    rows, held = [], 0
            if rows:
                parts.append(_Part(path, rows, start))
        return parts or [_Part(self.path, [], 0)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.rows:
            return
        with open(partition.path, "rb") as f:
            for i, name, dtype, shape, begin, end in partition.rows:
                f.seek(partition.start + begin)
                yield partition.path, i, name, dtype, shape, begin, end, f.read(end - begin)


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceWriter):
    """Each task writes one file; names are those of the rows, so a task must not hold a name twice."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        tensors: dict[str, tuple] = {}
        for row in iterator:
            if row["name"] in tensors:
                raise ValueError(f"two tensors are named {row['name']!r}")
            tensors[row["name"]] = (row["dtype"], tuple(row["shape"]), bytes(row["raw"]))
        if not tensors:
            return _Written("")
        os.makedirs(self.path, exist_ok=True)
        context = TaskContext.get()
        final = os.path.join(self.path, f"part-{context.partitionId():05d}-{self.job}.safetensors")
        with open(f"{final}.{context.taskAttemptId()}", "wb") as f:
            f.write(build_safetensors(tensors))
        os.replace(f.name, final)
        return _Written(final)

    def commit(self, messages: list) -> None:
        keep = {m.path for m in messages if m}
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, "part-*.safetensors")):
                if old not in keep:
                    os.unlink(old)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.unlink(m.path)


class SafetensorsDataSource(DataSource):
    """Options: ``path`` (a file or a folder of files), ``partBytes``."""

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("partBytes", 128 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Add the format to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SafetensorsDataSource)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Tensors of all safetensors files or containers under a path, plain or compressed; told apart by their first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, blob in zip(batch[0].to_pylist(), batch[1], strict=True):
                data = blob.as_buffer()
                raw = memoryview(data)
                if bytes(raw[:4]) == CONTAINER:
                    raw = memoryview(decompress_checkpoint(bytes(raw)))
                _, tensors, _, start = parse_safetensors(raw)
                for i, t in enumerate(tensors):
                    row = ([p], [i], [t.name], [t.dtype], [list(t.shape)], [t.begin], [t.end], [bytes(raw[start + t.begin : start + t.end])])
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["path", "ordinal", "name", "dtype", "shape", "begin", "end", "raw"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)
