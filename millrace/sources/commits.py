"""Tables of an iterative job that are done, so that a job started again goes on where it stopped.

A round is written to a new folder first. One line in the log then makes it part of the job; the
line is one file, which appears by a single rename. A folder without a line, left by a job that was
killed, is never read.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.session import fresh_path

_LINE = "number bigint, path string, n_rows bigint, kind string, at bigint"


@dataclass(frozen=True)
class Commit:
    number: int
    path: str
    n_rows: int
    schema: str


class CommitLog:
    """Numbered tables under ``folder``, which every executor can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commits(self) -> dict[int, Commit]:
        """Number to commit. Of two lines with one number, written by two drivers, the earlier holds."""
        try:
            lines = self.spark.read.schema(_LINE).json(f"{self.folder}/log").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        found: dict[int, Commit] = {}
        for line in sorted(lines, key=lambda x: (x["at"], x["path"]), reverse=True):
            found[line["number"]] = Commit(line["number"], line["path"], line["n_rows"], line["kind"])
        return found

    def write(self, number: int, df: DataFrame, partition_by: tuple[str, ...] = (), at_least: int | None = None) -> DataFrame:
        """Write a round's table, commit it, and read it back.

        A table of fewer than ``at_least`` rows is refused: it stays without a line.
        """
        path = fresh_path(self.spark, f"round-{number}")
        df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
        schema = df.schema.json()
        n_rows = self.spark.read.schema(df.schema).parquet(path).count()
        if at_least is not None and n_rows < at_least:
            raise ValueError(f"round {number} has {n_rows} rows, less than {at_least}")
        line = {"number": number, "path": path, "n_rows": n_rows, "kind": schema, "at": time.time_ns()}
        one = self.spark.range(0, 1, 1, 1).select(*[F.lit(value).alias(name) for name, value in line.items()])
        one.write.mode("append").json(f"{self.folder}/log")
        return self.read(self.commits()[number])

    def read(self, *commits: Commit) -> DataFrame:
        """The rows of a commit, or of several of one schema."""
        from pyspark.sql.types import StructType
        import json

        return self.spark.read.schema(StructType.fromJson(json.loads(commits[0].schema))).parquet(*[commit.path for commit in commits])
