"""Sources, sinks, rounds and the streaming counterpart."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import telemetry as T
from millrace.operators.synthetic import iterative_rounds
from millrace.session import fresh_path, stage
from millrace.sources import manifests, readers, writers
from millrace.streaming.telemetry_stream import metrics_stream, run_to_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unknown_corpus(spark):
    with pytest.raises(NotImplementedError):
        readers.load_corpus(spark, {}, "nothing")
    corpora = {"d": readers.Corpus("/root/testdata/sf0.001/documents.parquet", {"en": F.col("lang") == "en"})}
    with pytest.raises(ValueError):
        readers.load_corpus(spark, corpora, "d", config="xx")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan(readers.load_corpus(spark, corpora, "d", config="en"))


def test_only_one_way_to_name_preferences(spark):
    with pytest.raises(ValueError):
        readers.read_preferences(spark)
    with pytest.raises(ValueError):
        readers.read_preferences(spark, name="a", file="b.json")
    with pytest.raises(ValueError):
        readers.read_preferences(spark, file="b.csv")
    bad = spark.createDataFrame([("p", "c")], "prompt string, completion string")
    with pytest.raises(ValueError):
        readers.read_preferences(spark, name="x", load=lambda n: bad)


def test_preferences_from_a_mixture(spark):
    kind = "pair_id bigint, chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>, extra int"
    part = spark.createDataFrame([(i, [("user", "a")], [("user", "b")], 1) for i in range(20)], kind)
    got = readers.read_preferences(spark, mixer_list=["x", 1.0, "y", 3], load=lambda n: part)
    assert got.columns == ["pair_id", "chosen", "rejected"] and got.count() == 23


def test_one_chunk_is_read_by_pruning(spark):
    path = fresh_path(spark, "chunks")
    rows = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("shard_id"), F.col("id").alias("instance_id"), F.array(F.col("id").cast("int")).alias("input_ids"))
    writers.write_token_shards(rows, path, "instance_id", "shard_id")
    one = readers.read_token_chunks(spark, path, "s1", 10)
    text = plan(one)
    assert "PartitionFilters: [isnotnull(shard_id" in text and "EqualTo(instance_id,10)" in text
    assert one.first()["input_ids"] == [10]


def test_manifest_rules(spark):
    with pytest.raises(ValueError):
        manifests.build_manifest(spark, ["a"], {"x": ["b"]})
    with pytest.raises(ValueError):
        manifests.build_manifest(spark)
    got = manifests.build_manifest(spark, datasets={"z": ["1"], "a": ["2", "3"]}).orderBy("ordinal").collect()
    assert [(r["label"], r["path"]) for r in got] == [("a", "2"), ("a", "3"), ("z", "1")]


def test_compressed_and_plain_lines_read_alike(spark):
    base = fresh_path(spark, "mixed")
    docs = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, text string")
    docs.where("id = '1'").write.option("compression", "gzip").json(base + "/one")
    docs.where("id = '2'").write.json(base + "/two")
    got = readers.read_documents(spark, [base + "/one/*.json.gz", base + "/two/*.json"], "id string, text string", source="here")
    assert sorted(tuple(r) for r in got.collect()) == [("1", "a", "here"), ("2", "b", "here")]


def test_furthest_stage_and_longer_file(spark):
    rows = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 1, "b"), (1, 2, 2, "c"), (2, 1, 5, "d")], "case_id bigint, stage bigint, round bigint, x string")
    assert {r["case_id"]: r["x"] for r in writers.furthest_stage(rows).collect()} == {1: "c", 2: "d"}
    assert writers.prefer_longer(rows, rows.limit(1)) is rows


def test_rounds_stop_when_all_are_solved(spark):
    calls = []

    def attempt(still_open, number):
        calls.append(number)
        return still_open.where(F.col("case_id") <= number).withColumn("result", F.lit("ok"))

    got = iterative_rounds(spark.range(3).withColumnRenamed("id", "case_id"), attempt, 9, lambda d: stage(d, "t"))
    assert sorted((r["case_id"], r["round"]) for r in got.collect()) == [(0, 0), (1, 1), (2, 2)]
    assert calls == [0, 1, 2]


def test_stream_equals_batch_over_many_files(spark):
    n, window = 400, 5
    rows = [(i % 2, i + 1, i * 1.5, i * 1.5 + 0.25, 10 + i % 7, float((i * 37) % 101 + 1), i % 23 == 22) for i in range(n)]
    schema = "rank bigint, step bigint, start_s double, check_s double, tokens bigint, loss double, reset boolean"
    folder = fresh_path(spark, "feed")
    for k in range(5):
        spark.createDataFrame(rows[k * 80 : (k + 1) * 80], schema).coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.endswith(".parquet") and not f.startswith("."):
                path = os.path.join(folder, f)
                if os.path.getmtime(path) > 1e9 + 100:  # newest: give it its place in the feed
                    os.utime(path, (1e9 + k, 1e9 + k))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream = metrics_stream(feed, window, factor=3.0, warmup=10, interval=2)
    got = run_to_table(spark, stream, fresh_path(spark, "out"), fresh_path(spark, "log"))
    batch = spark.createDataFrame(rows, schema)
    rates = T.sliding_throughput(batch, window).join(T.running_min_loss(batch).select("rank", "step", "min_loss"), ["rank", "step"])
    cols = ["rank", "step", "window_tokens", "window_batches", "tokens_per_second", "batches_per_second", "min_loss"]
    want = {(r["rank"], r["step"]): tuple(r)[2:] for r in rates.select(*cols).collect()}
    seen = {(r["rank"], r["step"]): tuple(r)[2:] for r in got.select(*cols).collect()}
    assert seen.keys() == want.keys()
    for key, (tokens, batches, tps, bps, low) in want.items():
        assert seen[key][4] == low
        if tokens is None:
            assert seen[key][1] == 0 and seen[key][2] is None
        else:
            assert seen[key][:2] == (tokens, batches) and seen[key][2] == pytest.approx(tps) and seen[key][3] == pytest.approx(bps)
    stops = {r["rank"]: r["step"] for r in got.where("stop").select("rank", "step").collect()}
    want_stops = {r["rank"]: r["stop_step"] for r in T.early_stop(batch, 3.0, 10, 2).collect()}
    assert stops == want_stops


def test_stored_position_counts_over_files(spark):
    path = fresh_path(spark, "many")
    spark.range(1000).select(F.col("id"), F.lit("x" * 50).alias("text")).repartition(7).write.parquet(path)
    placed = readers.stored_position(spark, path, ["id", "text"])
    assert sorted(r["position"] for r in placed.select("position").collect()) == list(range(1000))
    text = plan(placed)
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text
    one_file = fresh_path(spark, "one")
    spark.range(100).coalesce(1).write.parquet(one_file)
    assert all(r["id"] == r["position"] for r in readers.stored_position(spark, one_file, ["id"]).collect())


def test_wide_rows_stay_where_they_are(spark):
    """Folds and amounts are decided on keys alone."""
    from millrace.operators import mixture

    wide = spark.range(200).select("id", F.lit("x" * 100).alias("text"))
    for df in (readers.with_folds(wide, "id"), mixture.mix_datasets({"a": wide}, {"a": 17}, "id", 1)):
        main = plan(df).split("Subquery")[0]
        assert "Exchange" not in main
    assert mixture.mix_datasets({"a": wide}, {"a": 17}, "id", 1).count() == 17
