"""The cycle of rounds after a kill, flat token files, shards of a size, batches of documents, the order without a table."""

from __future__ import annotations

import json
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

from millrace.operators import cycle, placing, synthetic
from millrace.operators.synthetic import gold_number
from millrace.sources import flat_tokens, writers
from millrace.sources.commits import CommitLog

# --- rounds ------------------------------------------------------------------------------

MASKED = '"2 boxes" to "Boxes" (num_x: int)\nSo the question becomes\nHow many?\nWith parameters\nnum_x=2'
# answers of a case's programs, one per round; the right one is its id
SAID = {1: ["1"], 2: ["x", "2"], 3: ["9", "9", "3.0"], 4: [], 5: ["7"] * 9, 6: ["loop", "6"]}


class Killed(Exception):
    pass


class Standin:
    """A model and a runner that remember who was asked, and stop the job in a given round."""

    def __init__(self, spark, stop=None):
        self.spark, self.stop, self.asked = spark, stop, []

    def model(self, kind, number, prompts):
        if number == self.stop:
            raise Killed
        ids = sorted(r.case_id for r in prompts.select("case_id").collect())
        self.asked.append((kind, number, ids))
        if kind == "mask":
            rows = [(i, MASKED) for i in ids]
        else:
            rows = [(i, program(SAID[i][number])) for i in ids if number < len(SAID[i])]
        return self.spark.createDataFrame(rows, "case_id bigint, response string")

    def runner(self, number, calls):
        rows = [(r.case_id, r.program.split()[-1]) for r in calls.collect() if r.program]
        assert not any("while True:" in r.program for r in calls.collect())
        return self.spark.createDataFrame(rows, "case_id bigint, result string")


def program(said):
    return "Sure:\ndef answer(x):\n    while True: pass\n```" if said == "loop" else f"Sure:\ndef answer(x): return {said}\n```"


def solve(spark, folder, stop=None, outer=3, inner=2):
    cases = spark.createDataFrame([(i, f"Buy 2 boxes, {i}?", f"They are\n#### {i}") for i in SAID], "case_id bigint, question string, answer string")
    standin = Standin(spark, stop)
    found = cycle.solve_cases(cases, CommitLog(spark, folder), standin.model, standin.runner, outer, inner)
    return {r.case_id: r for r in found.collect()}, standin.asked


@pytest.fixture(scope="module")
def solved(spark, tmp_path_factory):
    return solve(spark, str(tmp_path_factory.mktemp("whole")))


def test_cycle_ends_each_case_in_its_round(solved):
    found, asked = solved
    assert {i: (r["round"], r.solved, r.correct) for i, r in found.items()} == {
        1: (0, True, 100.0), 2: (1, True, 50.0), 3: (2, True, 100.0), 4: (5, False, 0.0), 5: (5, False, 0.0), 6: (1, True, 50.0)
    }
    assert found[2].results == ["x", "2"] and found[6].results == ["", "6"]
    assert [len(found[i].prev) for i in (1, 3, 5)] == [0, 1, 2]
    assert found[3].prev[0].results == ["9", "9"] and found[3].prev[0].correct == 0.0 and found[3].results == ["3.0"]
    assert found[1].masked_question == "Buy Boxes (num_x: int), 1?" and found[1].parameters == "num_x=2"
    assert found[4].programs == ["", ""]


def test_programs_are_cleaned_as_line_by_line(spark):
    rng = random.Random(5)
    bits = ["def", "'''", "\n", "\n", "\n", "```", "Program Ends", "PROGRAM ENDS", "program  ends", " ", "x", "é", "\r", "\u2028", "\x85", "de", "`"]
    told = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(3000)] + [(3000, "def f" + "\nx = 1" * 50_000 + "\n```")]

    def cleaned(text):
        lines = text.split("\n")
        begin = next((i for i, line in enumerate(lines) if line.startswith(("def", "'''"))), len(lines))
        end = next((i for i in range(begin, len(lines)) if "```" in lines[i] or "program ends" in lines[i].lower()), len(lines))
        return "\n".join(lines[begin:end])

    got = spark.createDataFrame(told, "i int, t string").select("i", synthetic.clean_program(F.col("t")).alias("p")).collect()
    assert dict(got) == {i: cleaned(t) for i, t in told}


def test_rounds_ask_only_open_cases(solved):
    _, asked = solved
    assert [(k, n) for k, n, _ in asked] == [("mask", 0), ("program", 0), ("program", 1), ("mask", 2), ("program", 2), ("program", 3), ("mask", 4), ("program", 4), ("program", 5)]
    assert {n: ids for k, n, ids in asked if k == "program"} == {0: [1, 2, 3, 4, 5, 6], 1: [2, 3, 4, 5, 6], 2: [3, 4, 5], 3: [4, 5], 4: [4, 5], 5: [4, 5]}


@pytest.mark.parametrize("stop", [0, 1, 3])
def test_a_killed_cycle_goes_on(spark, tmp_path, solved, stop):
    with pytest.raises(Killed):
        solve(spark, str(tmp_path), stop)
    found, asked = solve(spark, str(tmp_path))
    assert found == solved[0]
    assert min(n for _, n, _ in asked) == stop  # committed rounds are read, not asked again
    again, asked = solve(spark, str(tmp_path))
    assert again == found and asked == []


def test_query_has_the_rounds_of_the_original(spark, tmp_path, monkeypatch):
    from millrace.plans import synthetic as plan

    # one order whose first line is right, and one that nothing solves: its answer is "1,002"
    orders = [(1, 5, 10.5, "F"), (11, 5, 10.5, "F")]
    lines = [(1, 1, 3, 1, 2, 7.0), (11, 1, 3, 1, 2, 7.0)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity bigint, l_extendedprice double"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    asked = []
    whole = cycle.solve_cases

    def short(cases, log, model, runner, outer=30, inner=5, seed=96):
        asked.append((outer, inner))
        return whole(cases, log, model, runner, 2, inner, seed)  # the other 28 are alike

    monkeypatch.setattr(plan.cycle, "solve_cases", short)
    found = {r.case_id: r for r in plan.iterative_rounds(spark, str(tmp_path)).collect()}
    assert asked == [(30, 5)]
    assert (found[1]["round"], found[1].solved, found[1].n_programs, found[1].n_prev) == (0, 1, 1, 0)
    assert (found[11]["round"], found[11].solved, found[11].n_programs, found[11].n_prev) == (9, 0, 5, 1)


def test_earlier_attempts_keep_their_order_and_null_ids(spark, tmp_path):
    cases = spark.createDataFrame([(1, "Buy 2?", "#### 8"), (None, "Buy 2?", "#### 9")], "case_id bigint, question string, answer string")
    told = spark.createDataFrame([(1, MASKED)], "case_id bigint, response string")
    asked = []

    def model(kind, number, prompts):
        asked.append((kind, number, sorted(str(r.prompt[-1].content) for r in prompts.collect())))
        return told if kind == "mask" else spark.createDataFrame([(1, program(str(number)))], "case_id bigint, response string")

    def runner(number, calls):
        solvable = [(1, f"def answer(x): return {number}", "num_x=2")] if number < 9 else []
        assert sorted((r.case_id or 0, r.program, r.parameters) for r in calls.collect()) == [(0, "", ""), *solvable]
        return spark.createDataFrame([(1, str(number))], "case_id bigint, result string")

    log = CommitLog(spark, str(tmp_path))
    found = {r.case_id: r for r in cycle.solve_cases(cases, log, model, runner, 4, 3).collect()}
    assert [list(p.results) for p in found[1].prev] == [["0", "1", "2"], ["3", "4", "5"]] and found[1].results == ["6", "7", "8"]
    assert (found[1]["round"], found[1].solved, found[1].correct) == (8, True, 100 / 3)
    assert (found[None]["round"], found[None].solved, found[None].answer, len(found[None].prev)) == (11, False, "#### 9", 3)
    assert [p.programs for p in found[None].prev] == [["", "", ""]] * 3
    assert all(texts == ["Buy 2?", "Buy 2?"] for _, _, texts in asked[:12])
    # a round's table has what its outer round added, no earlier attempts
    tables = [log.read(commit) for commit in log.commits().values()]
    assert len(tables) == 12 and all("prev" not in t.columns and t.selectExpr("max(size(programs))").first()[0] <= 3 for t in tables)


def test_commits_are_lines_not_folders(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    assert log.commits() == {}
    three = spark.range(3)
    assert log.write(0, three, at_least=3).count() == 3
    with pytest.raises(ValueError):
        log.write(1, spark.range(2), at_least=3)
    assert sorted(log.commits()) == [0] and log.commits()[0].n_rows == 3
    log.write(0, spark.range(9))  # a second driver comes too late
    assert log.read(log.commits()[0]).count() == 3


def test_gold_number_of_the_cases(spark):
    assert spark.sql("SELECT 'a\n#### 12' AS t").select(gold_number(F.col("t")).alias("g")).first()["g"] == 12.0


# --- flat token files --------------------------------------------------------------------


def token_rows(n, size=4, start=0, step=1):
    rng = np.random.default_rng(3)
    return [(start + i * step, rng.integers(0, 65536, size).tolist(), (rng.random(size) < 0.5).tolist()) for i in range(n)]


ROW = "conv_id bigint, input_ids array<int>, label_mask array<boolean>"


def test_flat_files_give_the_rows_back(spark, tmp_path):
    rows = token_rows(50, step=9000)  # several ranges of keys, so several files
    flat_tokens.write_flat_tokens(spark.createDataFrame(rows, ROW).repartition(5), f"{tmp_path}/t", "conv_id")
    files = flat_tokens.listed(f"{tmp_path}/t")
    assert len(files) == len({k >> 16 for k, _, _ in rows}) and [f.first for f in files] == sorted(f.first for f in files)
    back = flat_tokens.read_flat_tokens(spark, f"{tmp_path}/t", 4)
    assert [(r.input_ids, r.label_mask) for r in back.orderBy("instance_id").collect()] == [r[1:] for r in rows]
    assert [tuple(r)[1:] for r in back.where("instance_id = 17").collect()] == [rows[17][1:]]
    assert sorted(r.instance_id for r in back.where("instance_id in (3, 40, 99)").collect()) == [3, 40]
    assert back.where("instance_id >= 10 and instance_id < 13 and size(input_ids) = 4").count() == 3
    # other chunk sizes cut the same tokens; what is shorter than a chunk is left out per file
    flat = sum((r[1] for r in rows), [])
    per_file = Counter(k >> 16 for k, _, _ in rows)
    assert flat_tokens.read_flat_tokens(spark, f"{tmp_path}/t", 6).count() == sum(4 * n // 6 for n in per_file.values()) <= len(flat) // 6


def test_one_chunk_reads_only_its_bytes(tmp_path):
    np.arange(1000, dtype="<u2").tofile(f"{tmp_path}/a.npy")
    np.arange(1000, 2024, dtype="<u2").tofile(f"{tmp_path}/b.npy")
    (np.arange(1024) % 3 == 0).tofile(f"{tmp_path}/mask.npy")
    options = {"chunk_size": "100", "files": json.dumps([[f"{tmp_path}/a.npy", None], [f"{tmp_path}/b.npy", f"{tmp_path}/mask.npy"]])}

    def read(*filters):
        reader = flat_tokens.FlatReader(options)
        left = list(reader.pushFilters(list(filters)))
        parts = reader.partitions()
        size = sum(n for p in parts for _, _, n in reader.byte_ranges(p))
        return left, size, [r for p in parts for b in reader.read(p) for r in b.to_pylist()]

    left, size, rows = read(EqualTo(("instance_id",), 12))
    assert left == [] and size == 300 and len(rows) == 1
    assert rows[0]["input_ids"] == list(range(1200, 1300)) and rows[0]["label_mask"] == [i % 3 == 0 for i in range(200, 300)]
    _, size, rows = read(In(("instance_id",), (0, 11, 500)), LessThan(("instance_id",), 11))
    assert size == 200 and rows[0]["label_mask"] is None
    left, size, rows = read(GreaterThan(("instance_id",), 17), EqualTo(("other",), 1))
    assert len(left) == 1 and size == 600 and [r["instance_id"] for r in rows] == [18, 19]
    _, size, rows = read()
    assert size == 2 * 2000 + 1000 and len(rows) == 20  # both files whole, less the tail of b


def test_a_mask_of_another_length_is_an_error(tmp_path):
    np.arange(40, dtype="<u2").tofile(f"{tmp_path}/a.npy")
    np.zeros(20, bool).tofile(f"{tmp_path}/m.npy")
    with pytest.raises(ValueError):
        flat_tokens.FlatReader({"chunk_size": "10", "files": json.dumps([[f"{tmp_path}/a.npy", f"{tmp_path}/m.npy"]])}).partitions()
    with pytest.raises(FileNotFoundError):
        flat_tokens.FlatReader({"chunk_size": "10", "files": json.dumps([[f"{tmp_path}/none.npy", None]])}).partitions()


def test_files_of_a_failed_task_are_never_seen(spark, tmp_path):
    path = f"{tmp_path}/t"
    writer = flat_tokens.FlatWriter({"path": path}, ["key", "input_ids", "label_mask"])

    def batch(rows):
        return pa.RecordBatch.from_pylist([{"key": k, "input_ids": i, "label_mask": m} for k, i, m in rows],
                                          schema=pa.schema([("key", pa.int64()), ("input_ids", pa.list_(pa.int32())), ("label_mask", pa.list_(pa.bool_()))]))

    def fails():
        yield batch(token_rows(3))
        raise Killed

    with pytest.raises(Killed):
        writer.write(fails())
    left_behind = set(os.listdir(path))
    assert left_behind and not os.path.exists(f"{path}/{flat_tokens.LIST}")  # nothing to be read yet
    written = [writer.write(iter([batch(token_rows(3)), batch(token_rows(2, start=3))])), writer.write(iter([batch(token_rows(2, start=1 << 16))]))]
    writer.commit([written[1], None, written[0]])
    assert not left_behind & {os.path.basename(f.ids) for f in flat_tokens.listed(path)}
    assert flat_tokens.read_flat_tokens(spark, path, 4).count() == 7
    with pytest.raises(ValueError):
        writer.commit([written[0], written[0]])  # two tasks with the same keys


@pytest.mark.parametrize("rows", [
    [(1, [1, 2], [True])], [(1, None, [True])], [(1, [70_000], [True])], [(1, [-1], [True])], [(1, [1], [True]), (1, [2], [True])],
])
def test_broken_rows_are_refused(spark, tmp_path, rows):
    with pytest.raises(Exception, match="equally long|does not fit|not in order"):
        flat_tokens.write_flat_tokens(spark.createDataFrame(rows, ROW), f"{tmp_path}/t", "conv_id")
    assert not os.path.exists(f"{tmp_path}/t/{flat_tokens.LIST}")


# --- shards of a size --------------------------------------------------------------------


def test_files_end_at_the_limit(spark, tmp_path):
    rows = [(i, "w" * (i * 37 % 90), [None, "", "a:b", "x y"][i % 4 and i % 3]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    writers.write_size_shards(docs, f"{tmp_path}/out", "doc_id", F.octet_length("text"), 300)
    back = spark.read.schema("doc_id bigint, source string, text string, shard bigint").json(f"{tmp_path}/out")
    read = back.select("*", F.col("_metadata.file_path").alias("file")).collect()
    assert sorted((r.doc_id, r.text, r.source) for r in read) == sorted(rows)
    numbers = {r.doc_id: r.shard for r in writers.shard_by_size(docs, "doc_id", F.octet_length("text"), 300).collect()}
    assert {r.doc_id: r.shard for r in read} == numbers
    files = {}
    for r in read:
        files.setdefault(r.file, []).append(r)
    assert len(files) == len({(r.source, r.shard) for r in read}) > 10
    for own in files.values():
        assert [r.doc_id for r in own] == sorted(r.doc_id for r in own)
        assert sum(len(r.text) for r in own[:-1]) < 300 + 90


# --- documents to batches ------------------------------------------------------------------


def batches_by_hand(docs, chunk, world, batch, order):
    stream = {}
    for doc_id, source, ids in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        stream.setdefault(source, []).extend(ids)
    chunks = [stream[s][i : i + chunk] for s in sorted(stream, key=lambda s: (s is not None, s)) for i in range(0, len(stream[s]) - chunk + 1, chunk)]
    out = {}
    for position, instance in enumerate(order[: len(order) - len(order) % world]):
        key = (position % world, position // world // batch)
        out.setdefault(key, []).append((instance, chunks[instance]))
    return out, len(chunks)


@pytest.mark.parametrize("rows", [placing.INDEX_ROWS, 0])
def test_batches_hold_the_tokens_of_their_instances(spark, monkeypatch, rows):
    from millrace.operators.ordering import seeded_order
    from millrace.session import stage

    monkeypatch.setattr(placing, "INDEX_ROWS", rows)
    rng = np.random.default_rng(8)
    docs = [(i, [None, "a", "b", "b", "b"][i % 5], rng.integers(0, 99, rng.integers(0, 40)).tolist()) for i in range(60)]
    table = stage(spark.createDataFrame(docs, "doc_id bigint, source string, input_ids array<int>").withColumn("n_tokens", F.size("input_ids")))
    _, n = batches_by_hand(docs, 5, 3, 4, [])
    order = [r.instance_id for r in seeded_order(spark.range(n).withColumnRenamed("id", "instance_id"), 11).orderBy("position").collect()]
    want, _ = batches_by_hand(docs, 5, 3, 4, order)
    frame = placing.rank_batches(table, 5, 3, 4, 11)
    got = {(r["rank"], r.step): list(zip(r.instance_ids, r.input_ids)) for r in frame.collect()}
    assert got == want
    if rows:  # the only exchange with tokens is the one to the batches
        plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


# --- the order without a table -----------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 10, 97, 1000, 4097])
def test_places_and_instances_are_a_bijection(spark, n):
    rows = spark.range(2 * n).select((F.col("id") % n).alias("p"), F.floor(F.col("id") / n).alias("epoch"))
    rows = rows.withColumn("i", placing.instance_at(F.col("p"), n, 5, F.col("epoch")))
    found = rows.withColumn("back", placing.position_of(F.col("i"), n, 5, F.col("epoch"))).collect()
    for epoch in (0, 1):
        assert sorted(r.i for r in found if r.epoch == epoch) == list(range(n))
    assert all(r.back == r.p for r in found)
    if n >= 97:
        assert sum(r.i == r.p for r in found) < n / 10
        assert [r.i for r in found if r.epoch == 0] != [r.i for r in found if r.epoch == 1]


def test_a_batch_needs_no_shuffle(spark):
    wanted = spark.createDataFrame([(2, 1, 3)], "epoch bigint, rank bigint, step bigint")
    one = placing.batch_instances(wanted, 1003, 4, 8, 5)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    places = [(3 * 8 + p) * 4 + 1 for p in range(8)]
    order = spark.createDataFrame([(p, 2) for p in places], "p bigint, epoch bigint")
    want = [r[0] for r in order.select(placing.instance_at(F.col("p"), 1003, 5, F.col("epoch"))).collect()]
    assert [r.instance_id for r in sorted(one.collect(), key=lambda r: r.place)] == want
