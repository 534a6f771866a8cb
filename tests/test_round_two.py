"""Whole texts, lossless words, limits that raise, and keys that hold many rows or few."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluation, ordering, packing, synthetic, tasks, tokenize
from millrace.plans import shared
from millrace.plans.chat import PAIR_LEN
from millrace.session import shared_folder
from millrace.sources import writers

SF = "/root/testdata/sf0.01"


def test_words_without_an_id_come_back(spark):
    vocab = tokenize.Vocabulary(spark, ["one", "two"])
    rows = [(0, "one überraschung two 你好"), (1, ""), (2, None), (3, "two two"), (4, "x")]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(1)
    got = {r["id"]: r for r in tokenize.encode_documents(df, vocab, add_special=False).withColumn("back", vocab.decode(F.col("input_ids"))).collect()}
    assert [got[i]["back"] for i in range(5)] == ["one überraschung two 你好", "", "", "two two", "x"]
    assert got[3]["input_ids"] == [8, 8] and got[4]["input_ids"] == [tokenize.FIRST_BYTE + ord("x"), tokenize.WORD_END]


def test_every_word_of_the_documents_comes_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    vocab = tokenize.Vocabulary.of(docs, size=500)
    back = tokenize.encode_documents(docs, vocab).withColumn("back", vocab.decode(F.col("input_ids")))
    want = F.array_join(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0)), " ")
    assert back.where(F.col("back") != want).count() == 0


def test_too_many_ids_are_refused(spark):
    table = spark.range(7, 70_000).select(F.concat(F.lit("w"), "id").alias("token"), F.col("id").alias("token_id"))
    with pytest.raises(ValueError, match="16 bits"):
        tokenize.Vocabulary.from_table(table)


def test_no_conversation_is_cut(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    lengths = tokenize.chat_lengths(turns, shared.chat_vocab(spark, SF))
    assert lengths.agg(F.max("n_full")).first()[0] <= min(shared.CHAT_LEN, PAIR_LEN)


def test_messages_are_stripped_before_they_are_encoded(spark):
    seen = tokenize.BatchTokenizer(lambda texts: [[100 + len(t)] for t in texts])
    turns = spark.createDataFrame([(1, 0, "user", "  hi \n")], "conv_id bigint, turn bigint, role string, text string")
    assert tokenize.chat_encode(turns, seen).first()["input_ids"][2] == 102


def test_fifty_thousand_streams_in_turn(spark):
    streams = spark.range(100_000).select((F.col("id") % 50_000).alias("s"), F.col("id").alias("k"))
    got = ordering.interleave_round_robin(streams, "s", "k")
    assert got.where(F.col("position") != F.col("k")).count() == 0
    named = streams.withColumn("s", F.format_string("stream %06d", "s"))
    assert ordering.interleave_round_robin(named, "s", "k").where(F.col("position") != F.col("k")).count() == 0


def test_any_source_and_language_is_read(spark, tmp_path):
    rows = [(1, "a", "web", "it"), (2, "b", None, "it"), (3, "c", "src100", "xx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    import __spark_entry__ as entry

    got = {r["id"]: r["source"] for r in entry.queries()["read_documents"](spark, str(tmp_path)).collect()}
    assert got == {"1": "web", "2": None, "3": "src100"}
    assert {r["lang"] for r in entry.queries()["load_corpus"](spark, str(tmp_path)).collect()} == {"it", "xx"}


def test_subject_tasks_by_name(spark):
    rows = [(i, 9, "physics_x", "q", ["a", "b", "c", "d"], 1, "validation") for i in range(3)]
    kind = "doc_key bigint, turn bigint, subject string, question string, choices array<string>, answer bigint, split string"
    subject = tasks.subjects_of("stem")[0]
    docs = spark.createDataFrame(rows, kind).withColumn("subject", F.lit(subject))
    dev = docs.withColumn("doc_key", F.col("doc_key") + 100).unionByName(docs.withColumn("doc_key", F.col("doc_key") + 200))
    assert evaluation.subject_task_prompts(docs, dev, "mmlu_stem_var").count() == 21
    shown = evaluation.subject_task_prompts(docs, dev, "mmlu_stem_mc_5shot").first()
    assert shown["ctx_text"].count("Answer: B") == 5 and shown["ctx_text"].endswith("Answer:") and shown["continuations"] == [" A", " B", " C", " D"]
    names = [n for n in tasks.TASKS if n.startswith("mmlu_")]
    whole = evaluation.all_subject_prompts(docs, dev, names)
    single = [(n, *r) for n in names for r in evaluation.subject_task_prompts(docs, dev, n).collect()]
    assert single and sorted(map(tuple, whole.collect()), key=repr) == sorted(single, key=repr)
    assert evaluation.subject_task_prompts(docs, dev, "mmlu_humanities_test").count() == 0
    with pytest.raises(ValueError, match="subject_task_prompts"):
        tasks.task_prompts(docs, "mmlu_stem_var", ["doc_key"])


def test_a_full_case_takes_no_more(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id bigint")
    rows = [(c, s, "q", "4", "it is 4") for c, n in ((1, 3), (2, 1)) for s in range(n)]
    variants = spark.createDataFrame(rows, "case_id bigint, slot bigint, new_question string, new_answer string, new_prediction string")
    none = variants.select("case_id", "slot").limit(0)
    accepted, still_open = synthetic.quota_round(none, variants, cases, 3)
    assert {tuple(r) for r in still_open.collect()} == {(2, 1), (3, 0)}
    accepted, still_open = synthetic.quota_round(accepted, variants.withColumn("slot", F.col("slot") + 10), cases, 3)
    assert accepted.where("case_id = 1").count() == 3 and {tuple(r) for r in still_open.collect()} == {(2, 2), (3, 0)}


def test_a_shorter_stage_does_not_replace_a_longer(spark):
    assert writers.prefer_longer(spark.range(5), spark.range(4)).count() == 5
    assert writers.prefer_longer(spark.range(5), spark.range(5, 10)).first()[0] == 5


def test_an_unset_folder_is_an_error(spark):
    class Conf:
        def get(self, *_):
            return None

    class Nowhere:
        conf = Conf()

        class sparkContext:
            master = "local[2]"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Nowhere())


def test_late_steps_stop_the_stream(spark, tmp_path):
    from millrace.streaming.telemetry_stream import metrics_stream, run_to_table

    kind = "rank bigint, step bigint, start_s double, check_s double, tokens bigint, loss double, reset boolean"
    folder = str(tmp_path / "in")
    for step in (5, 3):
        spark.createDataFrame([(0, step, 0.0, 1.0, 1, 1.0, False)], kind).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
    with pytest.raises(Exception, match="came after"):
        run_to_table(spark, metrics_stream(stream, 2, 2.0, 0, 1), str(tmp_path / "out"), str(tmp_path / "cp"))


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 16])
def test_indices_of_files_come_in_stretches(spark, piece):
    files = [("a", 0, 7), ("b", 7, 7), ("c", 7, 8), ("d", 8, 30)]
    manifest = spark.createDataFrame(files, "path string, start bigint, end bigint")
    got = [r["index"] for r in packing.instance_ids(manifest, "index", piece).collect()]
    assert sorted(got) == list(range(30))
    assert packing.instance_ids(manifest.where("start = end"), piece=piece).count() == 0
    assert packing.instance_ids(manifest.limit(0), piece=piece).schema.simpleString() == "struct<instance_id:bigint>"
