"""Work in bounded pieces: bytes to Python functions, rows in order before they are filled up, programs cleaned when chosen."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators import synthetic as S, tokenize
from millrace.session import BATCH_BYTES, fresh_path
from millrace.sources import flat_tokens, writers
from millrace.streaming import telemetry_stream as T


def test_texts_go_to_python_some_megabytes_at_a_time(spark):
    tokenize.Vocabulary(spark, ["a"])

    @F.arrow_udf("bigint")
    def size(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    long = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("a b "), 500).alias("t"))
    assert long.select(size("t").alias("n")).agg(F.max("n")).first()[0] < 2 * BATCH_BYTES


def _cleaned(text):
    lines = text.split("\n")
    start = next((i for i, x in enumerate(lines) if x.startswith(("def", "'''"))), None)
    if start is None:
        return ""
    tail = lines[start:]
    end = next((i for i, x in enumerate(tail) if "program ends" in x.lower() or "```" in x), len(tail))
    return "\n".join(tail[:end])


def test_programs_are_cleaned_as_line_by_line(spark):
    rng = random.Random(4)
    parts = ["def f", "'''doc", " def", "", "x", "``", "```", "# Program ENDS", "the proGram ends.", "é İ ſ", "\r", "a```b", "defend", "\u2028def"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(2000)] + ["", "\n", "def\n" + "y = 1\n" * 20000, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.clean_program(F.col("t")).alias("p")).collect()
    assert all(r["p"] == (None if r["t"] is None else _cleaned(r["t"])) for r in rows)


def test_only_chosen_programs_are_cleaned(spark):
    rows = [(1, 0, "no", "5"), (1, 1, "def a\n```", "5.0"), (1, 2, "def b", "5"), (2, 0, "def math.c", "x"), (2, 1, "t\ndef math.d", "7"), (3, 0, "def e", "1")]
    candidates = spark.createDataFrame(rows, "case_id bigint, ordinal bigint, response string, result string")
    cases = spark.createDataFrame([(1, "#### 5"), (2, "#### 7"), (3, "#### 2")], "case_id bigint, answer string")
    cleaned = candidates.withColumn("program", S.clean_program(F.col("response")))
    late = S.first_correct_program(candidates, cases, program="response", clean=S.clean_program)
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, S.first_correct_program(cleaned, cases).collect())) == [
        (1, 0, ""), (2, 1, "import math\n\ndef math.d")]
    text = late._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("program ends") == 1 and text.index("program ends") < text.index("Join")


def test_rows_are_put_in_order_before_they_are_filled_up(spark):
    rows = spark.createDataFrame([(i, [7] * (i % 5), [True] * (i % 5)) for i in range(9000, 0, -1)], "k bigint, input_ids array<int>, label_mask array<boolean>")

    def fill(df):
        return tokenize.fit_to_length(df, 6)

    shards, flat = fresh_path(spark, "shards"), fresh_path(spark, "flat")
    writers.write_token_shards(rows, shards, "k", finish=fill, bits=10)
    want = {r["k"]: (r["input_ids"], r["label_mask"]) for r in fill(rows).collect()}
    assert {r["k"]: (r["input_ids"], r["label_mask"]) for r in spark.read.parquet(shards).collect()} == want
    flat_tokens.write_flat_tokens(rows, flat, "k", finish=fill)
    back = {r["instance_id"] + 1: (r["input_ids"], r["label_mask"]) for r in flat_tokens.read_flat_tokens(spark, flat, 6).collect()}
    assert back == want


def test_metrics_in_slices_are_those_of_the_whole():
    rng = np.random.default_rng(1)
    n = 500
    rows = {"step": np.sort(rng.integers(0, 300, n)), "start_s": rng.random(n) * 9, "check_s": 9 + rng.random(n), "tokens": rng.integers(1, 9, n),
            "loss": rng.random(n), "reset": rng.random(n) < 0.05}
    start = T.Held([], [], float("inf"), False, False, None)
    whole, end = T._advance(rows, start, 7, 1.5, 20, 3)
    held, parts = start, []
    for at in range(0, n, 13):
        out, held = T._advance({k: v[at : at + 13] for k, v in rows.items()}, held, 7, 1.5, 20, 3)
        parts.append(out)
    for name in whole:
        joined = np.concatenate([np.asarray(p[name], float) for p in parts])
        assert np.array_equal(joined, np.asarray(whole[name], float), equal_nan=True), name
    assert held == end
