"""Lines of text in zstd files, as a Spark data source that needs no codec of Hadoop.

Spark lists the files; a task decodes one file as a stream, frame after frame, in blocks of bounded
size, so neither a file nor a frame has to fit in memory. Writing makes a file a task beside the final
names, and only those of tasks that succeeded are moved there when the job commits.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "zstd_lines"
SCHEMA = "value string, file string"
ENDING = ".zst"
BLOCK = 4 << 20
BATCH_LINES = 4096


@dataclass
class OneFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str | None


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path there. Spark's names are not escaped."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return fs.LocalFileSystem(), path


def lines_of(stream, block: int = BLOCK) -> Iterator[bytes]:
    """Lines of a decoded stream, read by blocks; line ends are those of text files. Empty lines may be added."""
    rest: list[bytes] = []
    while data := stream.read(block):
        # what follows the last line end goes on in the next block
        cut = max(data.rfind(b"\n"), data.rfind(b"\r")) + 1
        if cut:
            yield from b"".join((*rest, data[:cut])).splitlines()
            rest = []
        rest.append(data[cut:])
    yield from b"".join(rest).splitlines()


class ZstdLines(DataSource):
    """Options: ``files`` as a JSON list to read; ``path``, a new folder to write to."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZstdReader:
        return ZstdReader(json.loads(self.options["files"]))

    def writer(self, schema, overwrite: bool) -> ZstdWriter:
        if [f.name for f in schema] != ["value"]:
            raise ValueError("lines are written from one column, value")
        return ZstdWriter(self.options["path"])


class ZstdReader(DataSourceReader):
    def __init__(self, files: Sequence[str]):
        self.files = files

    def partitions(self) -> list[OneFile]:
        return [OneFile(path) for path in self.files]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        system, path = located(partition.path)
        with system.open_input_stream(path, compression=None) as raw, pa.CompressedInputStream(raw, "zstd") as stream:
            held, size = [], 0
            for line in lines_of(stream):
                if not line.strip():
                    continue
                held.append(line.decode("utf-8", "replace"))
                size += len(line)
                if len(held) == BATCH_LINES or size > BLOCK:
                    yield self._batch(held, partition.path)
                    held, size = [], 0
            if held:
                yield self._batch(held, partition.path)

    @staticmethod
    def _batch(lines: list[str], path: str) -> pa.RecordBatch:
        return pa.record_batch([pa.array(lines, pa.string()), pa.array([path] * len(lines), pa.string())], names=["value", "file"])


class ZstdWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.attempt = folder, f"_attempt-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = located(self.folder)
        path = os.path.join(folder, self.attempt, uuid.uuid4().hex)
        system.create_dir(os.path.dirname(path), recursive=True)
        n = 0
        with system.open_output_stream(path, compression=None) as raw, pa.CompressedOutputStream(raw, "zstd") as stream:
            for batch in iterator:
                for line in batch.column(0):
                    if line.is_valid:
                        stream.write(line.as_py().encode() + b"\n")
                        n += 1
        return Written(path if n else None)

    def commit(self, messages) -> None:
        system, folder = located(self.folder)
        paths = sorted(m.path for m in messages if m is not None and m.path)
        system.create_dir(folder, recursive=True)
        for i, path in enumerate(paths):
            system.move(path, os.path.join(folder, f"part-{i:05d}-{self.attempt[9:17]}.jsonl{ENDING}"))
        self._clear(system, folder)

    def abort(self, messages) -> None:
        self._clear(*located(self.folder))

    def _clear(self, system: fs.FileSystem, folder: str) -> None:
        left = os.path.join(folder, self.attempt)
        if system.get_file_info(left).type == fs.FileType.Directory:
            system.delete_dir(left)


def read_lines(spark: SparkSession, globs: Sequence[str]) -> DataFrame:
    """(value, file): the lines that are not blank. A file is one task, the largest first."""
    listed = spark.read.format("binaryFile").load(list(globs)).select("path", "length")
    files = [r.path for r in sorted(listed.collect(), key=lambda r: (-r.length, r.path))]  # as Spark's own file index
    spark.dataSource.register(ZstdLines)
    return spark.read.format(FORMAT).option("files", json.dumps(files)).load()


def read_json(spark: SparkSession, globs: Sequence[str], schema: str) -> DataFrame:
    """Records of JSON lines with the given schema, and ``__file``; a broken line is a record of nulls."""
    rows = read_lines(spark, globs).withColumn("__doc", F.from_json("value", schema))
    return rows.select("__doc.*", F.col("file").alias("__file"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Texts of the one column ``value``, without line ends, to a new folder; nulls are left out."""
    lines.sparkSession.dataSource.register(ZstdLines)
    lines.write.format(FORMAT).mode("append").save(path)
