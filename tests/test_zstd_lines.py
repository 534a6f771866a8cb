"""Lines in zstd files: equal to the same rows in gzip, frames, line ends, blocks, tasks that fail."""

from __future__ import annotations

import gzip
import io
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.sources import readers, zstd_lines

SCHEMA = "id string, text string, source string"


def compress(data: bytes) -> bytes:
    return pa.Codec("zstd").compress(data, asbytes=True)


def test_equals_gzip(spark, tmp_path):
    rows = [{"id": str(i), "text": f"te\u2028xt {i} é" * (i % 7), "source": None if i % 5 == 0 else "s"} for i in range(3000)]
    lines = [json.dumps(r, ensure_ascii=i % 2 == 0).encode() for i, r in enumerate(rows)] + [b"{broken", b"", b"   "]
    (tmp_path / "x=a%3Ab").mkdir()
    half = len(lines) // 2
    first, second = b"\r\n".join(lines[:half]) + b"\r\n", b"\n".join(lines[half:])
    (tmp_path / "x=a%3Ab" / "two frames.jsonl.zst").write_bytes(compress(first) + compress(second))
    (tmp_path / "x=a%3Ab" / "all.jsonl.gz").write_bytes(gzip.compress(first + second))
    (tmp_path / "x=a%3Ab" / "none.jsonl.zst").write_bytes(compress(b""))
    read = lambda *ends: readers.read_documents(spark, [f"{tmp_path}/x=*/*{e}" for e in ends], SCHEMA)
    old, new = read(".gz"), read(".zst")
    key = lambda r: tuple(map(str, r))
    assert new.schema == old.schema and sorted(new.collect(), key=key) == sorted(old.collect(), key=key)
    assert new.count() == 3001 and read(".gz", ".zst").count() == 6002
    named = readers.read_documents(spark, [f"{tmp_path}/x=*/*{e}" for e in (".gz", ".zst")], SCHEMA, source_pattern="/x=([^/]*)/")
    assert {r.source for r in named.select("source").distinct().collect()} == {"a:b"}


def test_lines_cross_blocks():
    data = b"one\r\ntwo\n\nthree is long\rfour"
    for block in range(1, len(data) + 2):
        assert [x for x in zstd_lines.lines_of(io.BytesIO(data), block) if x] == [b"one", b"two", b"three is long", b"four"]


def test_written_lines_come_back(spark, tmp_path):
    path = str(tmp_path / "out")
    lines = spark.range(500).select(F.when(F.col("id") != 3, F.concat(F.lit("é "), "id")).alias("value")).repartition(4)
    zstd_lines.write_lines(lines, path)
    got = zstd_lines.read_lines(spark, [f"{path}/*.zst"])
    assert sorted(r.value for r in got.collect()) == sorted(f"é {i}" for i in range(500) if i != 3)
    assert not list((tmp_path / "out").glob("_attempt*"))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = F.when(F.col("id") == 40, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("id").cast("string"))
    with pytest.raises(Exception, match="stop"):
        zstd_lines.write_lines(spark.range(0, 50, 1, 4).select(bad.alias("value")), path)
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
