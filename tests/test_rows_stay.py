"""No row vanishes and no value changes: null, empty and odd names, and keys that are null."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordering, packing, tokenize
from millrace.operators.prefix import dense_position, running_minimum, running_offset
from millrace.operators.tokenize import Vocabulary
from millrace.plans import corpus
from millrace.sources import readers, writers

NAMES = [None, "", "a:b", "x y", "p%q", "100%25", "a+b", "a/b=c", "ünï", "__HIVE_DEFAULT_PARTITION__", "=", "q?#"]


def test_running_sums_keep_null_groups_and_keys(spark):
    rows = [(g, k, 1) for g in (None, "", "=", "a") for k in (None, -5, 0, 70_000, 1 << 40)]
    got = running_offset(spark.createDataFrame(rows, "g string, k bigint, w int"), "k", F.col("w"), by=["g"]).collect()
    assert Counter((r.g, r.k) for r in got) == Counter(r[:2] for r in rows)
    for group in (None, "", "=", "a"):
        order = sorted((r for r in got if r.g == group), key=lambda r: (r.k is not None, r.k or 0))
        assert [r.offset for r in order] == list(range(5))
    numbers = spark.createDataFrame([(None, 1), (0, 1), (None, 2), (0, 2)], "g bigint, k bigint")
    assert sorted((r.g is None, r.k, r.position) for r in dense_position(numbers, "k", by=["g"]).collect()) == [
        (False, 1, 0), (False, 2, 1), (True, 1, 0), (True, 2, 1)
    ]
    least = running_minimum(numbers.withColumn("v", 5 - F.col("k")), "k", "v", by=["g"]).collect()
    assert sorted((r.g is None, r.k, r.running_min) for r in least) == [(False, 1, 4), (False, 2, 3), (True, 1, 4), (True, 2, 3)]


def test_shards_keep_documents_without_source_or_id(spark):
    docs = spark.createDataFrame([(1, "a", 10), (2, None, 10), (3, None, 10), (None, "a", 10)], "doc_id bigint, source string, n int")
    got = writers.shard_by_size(docs, "doc_id", F.col("n"), 10).collect()
    assert sorted((str(r.doc_id), r.source, r.shard) for r in got) == [("1", "a", 1), ("2", None, 0), ("3", None, 1), ("None", "a", 0)]


def test_chunks_keep_the_shard_without_name(spark):
    docs = spark.createDataFrame(
        [(1, None, [1, 2, 3], 3), (2, None, [4, 5], 2), (3, "s", [6, 7], 2), (None, "s", [8, 9, 10], 3)],
        "doc_id bigint, source string, input_ids array<int>, n_tokens int",
    )
    chunks = packing.pack_chunks(docs, 2)
    assert {(r.shard_id, r.chunk): r.input_ids for r in chunks.collect()} == {
        (None, 0): [1, 2], (None, 1): [3, 4], ("s", 0): [8, 9], ("s", 1): [10, 6]
    }
    numbered = packing.number_instances(chunks, packing.chunk_manifest(docs, 2)).collect()
    assert sorted(r.instance_id for r in numbered) == [0, 1, 2, 3]


def test_no_array_goes_through_the_window_of_offsets(spark):
    docs = spark.createDataFrame([(1, "s", [1], 1)], "doc_id bigint, source string, input_ids array<int>, n_tokens int")
    plan = packing.pack_chunks(docs, 2)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [line for line in plan if "Window [" in line]
    assert windows and not any("input_ids" in line for line in windows)
    below = [plan[plan.index(w) + 1] for w in windows]
    assert not any("input_ids" in line for line in below)


@pytest.mark.parametrize("seq_len", [None, 1, 8])
def test_turns_without_conversation_stay(spark, seq_len):
    rows = [(1, 0, "user", "hi"), (None, 0, "user", "hi"), (None, 1, "assistant", "ok"), (2, None, "user", "hi")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = tokenize.chat_encode(turns, Vocabulary(spark, ["hi", "ok"]), seq_len=seq_len).collect()
    if seq_len is None:
        assert sorted((str(r.conv_id), str(r.turn)) for r in got) == [("1", "0"), ("2", "None"), ("None", "0"), ("None", "1")]
    else:
        by_id = {r.conv_id: r.input_ids for r in got}
        assert set(by_id) == {None, 1, 2}
        assert by_id[None][:1] == [0] and (seq_len == 1) == (by_id[None] == [0])


def test_source_names_come_back(spark, tmp_path):
    rows = [(i, f"text {i}", name) for i, name in enumerate(NAMES)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus.read_documents(spark, str(tmp_path)).collect()
    assert sorted(((int(r.id), r.text, r.source) for r in got)) == rows


def test_names_of_folders_are_unescaped(spark, tmp_path):
    plain = [n for n in NAMES if n and not n.startswith("__")]
    docs = spark.createDataFrame([(str(i), "t", n) for i, n in enumerate(plain)], "id string, text string, source string")
    writers.write_jsonl(docs, f"{tmp_path}/out", partition_by=["source"])
    back = readers.read_documents(spark, [f"{tmp_path}/out/*/*.gz"], "id string, text string", source_pattern="source=([^/]+)/")
    assert {int(r.id): r.source for r in back.collect()} == dict(enumerate(plain))


def test_interleaving_keeps_the_stream_without_name(spark):
    rows = [(s, k) for s, n in ((None, 3), ("", 1), ("a", 2)) for k in range(n)]
    for kind, names in (("string", {None: None, "": "", "a": "a"}), ("bigint", {None: None, "": 0, "a": 1})):
        streams = spark.createDataFrame([(names[s], k) for s, k in rows], f"s {kind}, k bigint")
        got = {r.position: (r.s, r.k) for r in ordering.interleave_round_robin(streams, "s", "k").collect()}
        first, second, third = names[None], names[""], names["a"]
        assert got == {0: (first, 0), 1: (second, 0), 2: (third, 0), 3: (first, 1), 4: (third, 1), 5: (first, 2)}
