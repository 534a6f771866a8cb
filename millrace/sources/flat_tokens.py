"""Token files without structure, as a Spark data source: ids of two bytes, masks of one, end to end.

``spark.read.format("flat_tokens")`` cuts the files into chunks of ``chunk_size`` tokens numbered through
all files; a partition is a range of bytes, and a filter on ``instance_id`` leaves only the bytes of the
chunks that it allows. Writing starts a file for every range of the key; a list written at the end names
the files of tasks that succeeded, so what a failed task left behind is never seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)

FORMAT = "flat_tokens"
LIST = "_files.json"
SCHEMA = "instance_id bigint, input_ids array<int>, label_mask array<boolean>"
SPLIT_TOKENS = 16 << 20
STEP_TOKENS = 1 << 20
RANGE_BITS = 16
KINDS = {"uint8": "<u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8"}


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class TokenFile:
    """A file of ids and the file of its mask, or none; ``first`` and ``last`` are keys of its rows."""

    ids: str
    mask: str | None = None
    first: int = 0
    last: int = 0


@dataclass
class Stretch(InputPartition):
    """Some chunks of one file in a row."""

    file: TokenFile
    chunk: int
    chunks: int
    instance: int


@dataclass
class Written(WriterCommitMessage):
    files: list[TokenFile]


class FlatTokens(DataSource):
    """Options: ``path`` of a written folder, or ``files`` as JSON [[ids, mask or null], ...]; ``chunk_size``; ``dtype`` of the ids."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FlatReader:
        return FlatReader(self.options)

    def writer(self, schema, overwrite: bool) -> FlatWriter:
        return FlatWriter(self.options, [f.name for f in schema])


class FlatReader(DataSourceReader):
    def __init__(self, options):
        self.chunk = int(options["chunk_size"])
        self.kind = np.dtype(KINDS[options.get("dtype", "uint16")])
        self.files = [TokenFile(*f) for f in json.loads(options["files"])] if "files" in options else listed(options["path"])
        self.low, self.high, self.wanted = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = getattr(f, "attribute", None) == ("instance_id",)
            if known and isinstance(f, EqualTo):
                self._among({f.value})
            elif known and isinstance(f, In):
                self._among(set(f.value))
            elif known and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif known and isinstance(f, (LessThan, LessThanOrEqual)):
                end = f.value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    def _among(self, instances: set) -> None:
        instances = {i for i in instances if i is not None}
        self.wanted = instances if self.wanted is None else self.wanted & instances

    def partitions(self) -> list[Stretch]:
        out, start = [], 0
        for file, n in zip(self.files, self.lengths()):
            low, high = max(self.low, start), start + n if self.high is None else min(self.high, start + n)
            if self.wanted is not None:
                out += [Stretch(file, i - start, 1, i) for i in sorted(self.wanted) if low <= i < high]
            else:
                step = max(1, SPLIT_TOKENS // self.chunk)
                out += [Stretch(file, i - start, min(step, high - i), i) for i in range(low, high, step)]
            start += n
        return out

    def lengths(self) -> list[int]:
        """Whole chunks of every file; a mask of another length is an error."""
        counts = []
        for file in self.files:
            n = _size(file.ids) // (self.kind.itemsize * self.chunk)
            if file.mask is not None and _size(file.mask) // self.chunk != n:
                raise ValueError(f"masking file {file.mask!r} should be as long as {file.ids!r}")
            counts.append(n)
        return counts

    def byte_ranges(self, part: Stretch) -> list[tuple[str, int, int]]:
        """(file, offset, bytes) that a partition reads."""
        wide = self.kind.itemsize * self.chunk
        ranges = [(part.file.ids, part.chunk * wide, part.chunks * wide)]
        return ranges + ([(part.file.mask, part.chunk * self.chunk, part.chunks * self.chunk)] if part.file.mask else [])

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        step = max(1, STEP_TOKENS // self.chunk)
        for at in range(0, partition.chunks, step):
            n = min(step, partition.chunks - at)
            part = Stretch(partition.file, partition.chunk + at, n, partition.instance + at)
            ids, *mask = [_bytes(*r) for r in self.byte_ranges(part)]
            edges = pa.array(np.arange(n + 1, dtype=np.int32) * self.chunk)
            tokens = pa.ListArray.from_arrays(edges, pa.array(np.frombuffer(ids, self.kind).astype(np.int32)))
            if mask:
                labels = pa.ListArray.from_arrays(edges, pa.array(np.frombuffer(mask[0], np.uint8) != 0))
            else:
                labels = pa.nulls(n, pa.list_(pa.bool_()))
            numbers = pa.array(np.arange(part.instance, part.instance + n))
            yield pa.record_batch([numbers, tokens, labels], names=["instance_id", "input_ids", "label_mask"])


class FlatWriter(DataSourceArrowWriter):
    def __init__(self, options, names: list[str]):
        self.path, self.names = options["path"].rstrip("/"), names
        self.kind = np.dtype(KINDS[options.get("dtype", "uint16")])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Files of one task; its rows come sorted by the first column, and a range of it is a file."""
        system, folder = _located(self.path)
        system.create_dir(folder, recursive=True)
        files: list[TokenFile] = []
        streams: list = []
        try:
            for batch in iterator:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                heads = np.flatnonzero(np.append(True, keys[1:] >> RANGE_BITS != keys[:-1] >> RANGE_BITS)) if len(keys) else []
                for a, b in zip(heads, [*heads[1:], len(keys)]):
                    own = keys[a:b]
                    if not files or files[-1].last >> RANGE_BITS != own[0] >> RANGE_BITS:
                        for s in streams:
                            s.close()
                        names = [f"{kind}-{int(own[0]) >> RANGE_BITS}-{uuid.uuid4().hex}" for kind in ("ids", "mask")]
                        streams = [system.open_output_stream(f"{folder}/{name}") for name in names]
                        files.append(TokenFile(*[f"{self.path}/{name}" for name in names], int(own[0]), int(own[0]) - 1))
                    if (np.diff(np.append(files[-1].last, own)) <= 0).any():
                        raise ValueError("rows are not in order of a unique key")
                    files[-1] = TokenFile(files[-1].ids, files[-1].mask, files[-1].first, int(own[-1]))
                    for stream, data in zip(streams, self._pair(batch.slice(a, b - a))):
                        stream.write(data)
        finally:
            for s in streams:
                s.close()
        return Written(files)

    def _pair(self, rows: pa.RecordBatch) -> tuple[bytes, bytes]:
        ids, mask = rows.column(1), rows.column(2)
        if ids.null_count or mask.null_count or not ids.value_lengths().equals(mask.value_lengths()):
            raise ValueError(f"{self.names[1]} and {self.names[2]} are not equally long in every row")
        tokens = ids.flatten().to_numpy(zero_copy_only=False)
        if len(tokens) and (tokens.min() < 0 or tokens.max() > np.iinfo(self.kind).max):
            raise ValueError(f"an id does not fit in {self.kind.name}")
        return tokens.astype(self.kind).tobytes(), mask.flatten().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f.first)
        if any(a.last >= b.first for a, b in zip(files, files[1:])):
            raise ValueError("ranges of keys overlap")
        system, folder = _located(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/.{LIST}") as out:
            out.write(json.dumps([[f.ids, f.mask, f.first, f.last] for f in files]).encode())
        system.move(f"{folder}/.{LIST}", f"{folder}/{LIST}")

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing to undo: files that no list names are never read."""


def listed(path: str) -> list[TokenFile]:
    """The files of a committed folder, in order of their keys."""
    system, folder = _located(path.rstrip("/"))
    with system.open_input_stream(f"{folder}/{LIST}") as source:
        return [TokenFile(*f) for f in json.loads(source.read())]


def _size(path: str) -> int:
    system, name = _located(path)
    info = system.get_file_info(name)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def _bytes(path: str, offset: int, size: int) -> bytes:
    system, name = _located(path)
    with system.open_input_file(name) as source:
        return source.read_at(size, offset)


def use_flat_tokens(spark: SparkSession) -> None:
    """Register the format; filters reach a Python source only by this setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FlatTokens)


def write_flat_tokens(
    df: DataFrame, path: str, key: str, ids: str = "input_ids", mask: str = "label_mask", dtype: str = "uint16",
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Rows as flat files, in order of a unique integer key; each range of keys is a file of its own.

    ``finish`` is a projection of the rows that are in order, such as the one that fills them up to a length.
    """
    from millrace.session import small_batches
    from millrace.sources.writers import in_ranges

    use_flat_tokens(df.sparkSession)
    rows = in_ranges(df.select(F.col(key).cast("bigint").alias("key"), ids, mask), "key", bits=RANGE_BITS)
    if finish is not None:
        rows = finish(rows).select("key", ids, mask)
    small_batches(df.sparkSession)
    rows.write.format(FORMAT).mode("append").option("dtype", dtype).save(path)


def read_flat_tokens(spark: SparkSession, path: str | None, chunk_size: int, files: list | None = None, dtype: str = "uint16") -> DataFrame:
    """(instance_id, input_ids, label_mask) of a written folder, or of given (ids, mask or None) files in their order."""
    use_flat_tokens(spark)
    reader = spark.read.format(FORMAT).option("chunk_size", chunk_size).option("dtype", dtype)
    return reader.option("files", json.dumps(files)).load() if files is not None else reader.load(path)
