"""Small hand-made cases, one per behaviour that is easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions.periods import longest_repetition, periodic_sequences
from millrace.functions.text import last_number, strip, to_float
from millrace.operators import evaluation as E
from millrace.operators import normalize, ordering, packing, quality, synthetic as S, tasks, telemetry as T, tokenize
from millrace.operators.tokenize import Vocabulary


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("text, number", [
    ("1234", 4.0), ("1,234.5", 1234.5), ("-12345", 45.0), ("none", None), ("-50000000", 0.0), ("a 3 and +7.25.", 7.25),
])
def test_last_number(spark, text, number):
    assert one(spark, last_number("t"), t=text) == number


def test_last_number_default(spark):
    assert one(spark, last_number("t", S.NO_NUMBER), t="none") == -5e10


def test_grouped_gold_never_matches(spark):
    assert one(spark, S.gold_number(F.col("t")), t="so\n#### 1,000") is None
    assert one(spark, S.gold_number(F.col("t")), t="so\n#### 1000") == 1000.0


@pytest.mark.parametrize("text, ok", [("1_000", False), ("1d", False), ("1e3", True), (".5", True), ("5.", True), ("nan", False), ("", False)])
def test_number_guard(spark, text, ok):
    assert (one(spark, to_float("t"), t=text) is not None) == ok


def test_half_to_even_result_matches(spark):
    cases = spark.createDataFrame([(1, "x #### 2"), (2, "x #### 3"), (3, "x #### 1,000")], "case_id bigint, answer string")
    candidates = spark.createDataFrame(
        [(1, 0, "p0", "9"), (1, 1, "math.pi", "2.5"), (1, 2, "p2", "2"), (2, 0, "p", "oops"), (3, 0, "p", "1000")],
        "case_id bigint, ordinal bigint, program string, result string",
    )
    got = {r["case_id"]: (r["ordinal"], r["program"]) for r in S.first_correct_program(candidates, cases).collect()}
    assert got == {1: (1, "import math\n\nmath.pi")}
    scored = {r["case_id"]: r["correct"] for r in S.score_candidates(candidates, cases).collect()}
    assert scored[1] == pytest.approx(100 / 3) and scored[2] == 0 and scored[3] == 0


def test_replacement_orders(spark):
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(l).alias("label"), F.lit(c).alias("code")) for k, l, c in (("12", "N", "n"), ("12 inches", "L", "l"))])
    row = spark.range(1).select(
        S.apply_replacements(F.lit("12 inches"), entries).alias("a"), S.apply_replacements(F.lit("12 inches"), entries, True).alias("b")
    ).first()
    assert row["a"] == "N (n) inches"
    assert row["b"] == "L (l)"


def test_later_replacement_hits_earlier_output(spark):
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(l).alias("label"), F.lit("c").alias("code")) for k, l in (("a", "b"), ("b", "z"))])
    assert spark.range(1).select(S.apply_replacements(F.lit("a"), entries).alias("o")).first()["o"] == "z (c) (c)"


def test_parse_masking_response(spark):
    response = '"a" to "X" (x: int)\n"b" to "Y"\n"only one"\n"a" to "Z" (q) (z: int)\nSo the question becomes\nstated\nWith parameters\nx=1\n'
    df = spark.createDataFrame([(response, "a b a")], "response string, question string")
    row = S.parse_masking_response(df).first()
    assert [tuple(e) for e in row["replacement"]] == [("a", "Z", "q) (z: int")]
    assert row["stated_question"] == "stated" and row["parameters"] == "x=1"
    assert row["masked_question"] == "Z (q) (z: int) b Z (q) (z: int)"


def test_parse_masking_response_heading_on_last_line(spark):
    row = S.parse_masking_response(spark.createDataFrame([("With parameters", "q")], "response string, question string")).first()
    assert row["parameters"] == "" and row["replacement"] == []


def test_six_lines_drop_the_first(spark):
    assert one(spark, S.parse_parameter_lines(F.col("t")), t="Parameters:\nh\n1. a\n- b\nc\nd\ne") == ["1. a", "b", "c", "d", "e"]
    assert one(spark, S.parse_question_lines(F.col("t")), t="  \na \n\nb") == ["", "a", "b"]


@pytest.mark.parametrize("text, program", [
    ("x\ndef f():\n  pass\n# Program Ends\nrest", "def f():\n  pass"),
    ("```python\n'''doc'''\ndef f(): pass\n```\nmore", "'''doc'''\ndef f(): pass"),
    ("nothing here", ""),
    ("def f(): # the program ends", ""),
])
def test_clean_program(spark, text, program):
    assert one(spark, S.clean_program(F.col("t")), t=text) == program


@pytest.mark.parametrize("text, answer", [("so the answer is $12.50.", "12.50"), ("answer is 1 answer is 2", "2"), ("it is 1,000 km", ""), ("7.", "7")])
def test_parse_answer(spark, text, answer):
    assert one(spark, S.parse_answer(F.col("t")), t=text) == answer


def test_retry_placeholder_counts_zero_as_right(spark):
    q = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "d")], "case_id bigint, slot bigint, new_question string")
    a = spark.createDataFrame([(1, 0, "0"), (1, 1, "5"), (2, 0, "x"), (2, 1, "3")], "case_id bigint, slot bigint, new_answer string")
    p = spark.createDataFrame([(2, 0, "3")], "case_id bigint, slot bigint, new_prediction string")
    got = sorted((r["case_id"], r["slot"]) for r in S.select_retries(q, p, a).collect())
    assert got == [(1, 1), (2, 0)]


def test_align_to_the_shortest(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y"], [])], "case_id bigint, p array<string>, q array<string>, r array<string>")
    assert S.align_variants(df, ["p", "q"]).count() == 2
    assert S.align_variants(df, ["p", "q", "r"]).count() == 0


def test_merge_retries(spark):
    v = spark.createDataFrame([(1, 0, "old"), (1, 1, None)], "case_id bigint, slot bigint, new_prediction string")
    r = spark.createDataFrame([(1, 0, "new")], "case_id bigint, slot bigint, response string")
    assert {x["slot"]: x["new_prediction"] for x in S.merge_retries(v, r).collect()} == {0: "new", 1: ""}


def test_majority_tie_goes_to_the_first(spark):
    a = spark.createDataFrame([(1, 0, "5"), (1, 1, "7"), (1, 2, "7"), (1, 3, "5")], "case_id bigint, pos bigint, response string")
    assert S.majority_answer(a).first()["answer"] == "5"


def test_round_robin(spark):
    rows = [(s, i, x) for s, items in enumerate(("ABC", "D", "EF")) for i, x in enumerate(items)]
    df = spark.createDataFrame(rows, "stream bigint, item bigint, x string")
    got = ordering.interleave_round_robin(df, "stream", "item").orderBy("position").collect()
    assert "".join(r["x"] for r in got) == "ADEBFC"


@pytest.mark.parametrize("n, world, drop, size", [(10, 4, True, 8), (10, 4, False, 12), (3, 8, False, 8), (8, 4, True, 8), (8, 4, False, 8)])
def test_even_world(spark, n, world, drop, size):
    order = spark.range(n).select(F.col("id").alias("position"), (F.col("id") + 100).alias("instance_id"))
    got = ordering.even_world(order, world, drop).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(size))
    assert [r["instance_id"] for r in got] == [100 + p % n for p in range(size)]


def test_worker_stripe(spark):
    order = spark.range(10).select(F.col("id").alias("position"), F.col("id").alias("instance_id"))
    got = ordering.worker_stripe(ordering.rank_stripe(order, 1), 1, 0, batch=4, workers=2, total=10)
    by_worker = {}
    for r in got.orderBy("worker", "worker_seq").collect():
        by_worker.setdefault(r["worker"], []).append(r["instance_id"])
    assert by_worker == {0: [0, 1, 2, 3, 8], 1: [4, 5, 6, 7, 9]}


def test_resume():
    state = ordering.RunState(examples_seen=40, tokens_seen=999, fast_forward_batches=2, global_batch=8)
    assert state.resume() == (56, 999)
    assert ordering.RunState(40, epoch=1, checkpoint_epoch=0, tokens_seen=9).resume() == (0, 9)
    assert ordering.RunState(40, tokens_seen=9, restore=False).resume() == (0, 0)


def test_slice_order_needs_divisible_limit(spark):
    with pytest.raises(ValueError):
        ordering.slice_order(spark.range(5).withColumnRenamed("id", "position"), 4, 10)


def test_eval_batch_size():
    assert ordering.eval_batch_size(8, 12, 4, True) == 3
    assert ordering.eval_batch_size(8, 12, 4, False) == 8
    with pytest.raises(ValueError):
        ordering.eval_batch_size(8, 3, 4, True)


def test_pack_drops_the_remainder(spark):
    docs = spark.createDataFrame([("s", 0, [1, 2, 3], 3), ("s", 1, [], 0), ("s", 2, [4, 5, 6, 7, 8, 9, 10], 7), ("t", 3, [1], 1)],
                                 "source string, doc_id bigint, input_ids array<int>, n_tokens int")
    got = packing.pack_chunks(docs, 4).orderBy("shard_id", "chunk").collect()
    assert [(r["shard_id"], r["chunk"], r["input_ids"]) for r in got] == [("s", 0, [1, 2, 3, 4]), ("s", 1, [5, 6, 7, 8])]


def test_pack_keeps_masks_aligned(spark):
    docs = spark.createDataFrame([("s", 0, [1, 2, 3], [True, False, True], 3), ("s", 1, [4, 5], [False, True], 2)],
                                 "source string, doc_id bigint, input_ids array<int>, label_mask array<boolean>, n_tokens int")
    got = packing.pack_chunks(docs, 2, arrays=("input_ids", "label_mask")).orderBy("chunk").collect()
    assert [r["input_ids"] for r in got] == [[1, 2], [3, 4]]
    assert [r["label_mask"] for r in got] == [[True, False], [True, False]]


def test_locate_out_of_bounds(spark):
    manifest = spark.createDataFrame([("a", 0, 2, 0, 2), ("b", 1, 3, 2, 5)], "path string, ordinal bigint, n_chunks bigint, start bigint, end bigint")
    ok = spark.createDataFrame([(0,), (4,), (-1,), (-5,)], "index bigint")
    got = {r["index"]: (r["path"], r["local_index"]) for r in packing.locate_instance(ok, manifest).collect()}
    assert got == {0: ("a", 0), 4: ("b", 2), -1: ("b", 2), -5: ("a", 0)}
    for bad in (5, -6):
        with pytest.raises(Exception, match="out of bounds"):
            packing.locate_instance(spark.createDataFrame([(bad,)], "index bigint"), manifest).collect()


def test_consecutive_groups_of_any_step(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 4, 6, 8, 9)], "v bigint")
    assert sorted(tuple(r) for r in packing.consecutive_groups(df, "v").collect()) == [(0, 1, 2), (4, 4, 1), (6, 6, 1), (8, 9, 2)]
    assert sorted(tuple(r) for r in packing.consecutive_groups(df, "v", 2).collect()) == [(0, 0, 1), (1, 1, 1), (4, 8, 3), (9, 9, 1)]


def test_periods(spark):
    rows = [([1, 2, 3] * 5 + [9, 8, 7],), ([5, 5],), ([],), ([4, 4, 4],), ([1, 2, 1, 2],)]
    df = spark.createDataFrame(rows, "ids array<int>").coalesce(1)
    got = df.select(periodic_sequences(F.col("ids")).alias("r"), longest_repetition(F.col("ids")).alias("m")).collect()
    assert [[tuple(x) for x in r["r"]] for r in got] == [[(0, 15, 3, 5)], [], [], [(0, 3, 1, 3)], []]
    assert [r["m"] for r in got] == [5, 0, 0, 3, 0]


def test_period_mask_value_is_refused(spark):
    with pytest.raises(Exception, match="mask value"):
        spark.createDataFrame([([1, -1, 2],)], "ids array<int>").select(longest_repetition(F.col("ids"))).collect()


@pytest.mark.parametrize("flags, lead, trail", [
    ([False, False, True, True], 0, 2), ([True, True, False, False], 2, -1), ([True, True], 2, 0), ([False], 0, -1),
])
def test_edge_runs(spark, flags, lead, trail):
    assert one(spark, A.leading_run_end(F.col("f")), f=flags) == lead
    assert one(spark, A.trailing_run_start(F.col("f")), f=flags) == trail


WHAT = [65399, 65384, 65377, 65396, 65279]


def chat(spark, seq_len, rows, fit=None):
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    vocab = Vocabulary(spark, ["hi", "there", "ok"])
    return tokenize.fit_to_length(tokenize.chat_encode(turns, vocab, seq_len=seq_len), fit or seq_len)


def test_chat_encode(spark):
    row = chat(spark, 18, [(1, 0, "user", "  hi there\n"), (1, 1, "assistant", "ok what")]).first()
    # a word without an id is its bytes and the mark after them
    assert row["input_ids"] == [0, 4, 3, 7, 8, 3, 5, 3, 9, *WHAT, 0, 3, 1, 1]
    assert [i for i, m in enumerate(row["label_mask"]) if m] == [8, 9, 10, 11, 12, 13, 14]
    assert row["n_labels"] == 7


def test_reply_beyond_the_length_has_no_labels(spark):
    rows = chat(spark, 8, [(1, 0, "user", "hi"), (1, 1, "assistant", "ok"), (2, 0, "user", "hi hi hi"), (2, 1, "assistant", "ok")])
    kept = quality.has_labels(rows).select("conv_id").collect()
    assert [r[0] for r in kept] == [1]


def test_turn_limit_changes_nothing(spark):
    rows = [(1, t * 5, ("user", "assistant")[t % 2], "hi " * (t % 3)) for t in range(40)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    parts = tokenize.chat_encode(turns, Vocabulary(spark, ["hi"])).orderBy("turn").collect()
    ids = [0, *(i for r in parts for i in r["input_ids"])]
    mask = [False, *(m for r in parts for m in r["label_mask"])]
    for n in (1, 2, 3, 10, 31, 64):
        cut = chat(spark, n, rows).first()
        assert cut["input_ids"] == ids[:n] and cut["label_mask"] == mask[:n]


def test_long_conversation_has_one_shape(spark):
    turns = spark.range(5000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    got = tokenize.chat_encode(turns, Vocabulary(spark, ["hi"])).orderBy("turn").collect()
    assert [r["start"] for r in got] == [1 + 4 * t for t in range(5000)]
    assert {len(r["input_ids"]) for r in got} == {4}
    assert normalize.turns_to_text(turns).first()["text"] == "hi\n" * 5000


def test_any_batch_tokenizer_fits_in(spark):
    letters = tokenize.BatchTokenizer(lambda texts: [[ord(c) for c in t] for t in texts])
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id bigint, text string")
    got = tokenize.encode_documents(docs, letters, truncate_to=2).orderBy("doc_id").collect()
    assert [r["input_ids"] for r in got] == [[97, 0], [0]]


def test_pairs_are_encoded_per_message(spark):
    kind = "pair_id bigint, chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>"
    pairs = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "ok what")], [("assistant", "")])], kind)
    row = tokenize.encode_preferences(pairs, Vocabulary(spark, ["hi", "ok"])).first()
    assert row["chosen_input_ids"] == [0, 4, 3, 7, 3, 5, 3, 8, *WHAT, 0, 3]
    assert row["chosen_labels"] == [-100] * 7 + [8, *WHAT, 0, -100]
    assert row["rejected_input_ids"] == [0, 5, 3, 0, 3] and row["rejected_labels"] == [-100, -100, -100, 0, -100]
    row = tokenize.encode_preferences(pairs, tokenize.BatchTokenizer(lambda t: [[9] * len(x) for x in t]), bos=6, seq_len=6).first()
    assert row["chosen_input_ids"] == [6, 0, 4, 3, 9, 9] and row["chosen_attention_mask"] == [1] * 6
    with pytest.raises(ValueError):
        tokenize.encode_preferences(pairs, Vocabulary(spark, []), bos=0)
    empty = spark.createDataFrame([(1, [], [("user", "x")])], kind)
    with pytest.raises(Exception, match="chosen messages field is empty"):
        tokenize.encode_preferences(empty, Vocabulary(spark, [])).collect()


def test_removed_rows_are_counted_in_passing(spark):
    from pyspark.sql import Observation

    seen = Observation()
    rows = spark.createDataFrame([(0,), (3,), (0,)], "n_labels bigint")
    assert quality.has_labels(rows, seen).count() == 1 and seen.get["removed"] == 2


def test_model_hook_gets_small_lists(spark):
    prompts = spark.range(25).select(F.col("id").alias("prompt_id"), F.col("id").cast("string").alias("prompt")).coalesce(1)
    got = S.generate_responses(prompts, lambda texts: [f"{t}/{len(texts)}" for t in texts], size=10)
    answers = {r["prompt_id"]: r["response"] for r in S.join_responses(prompts, got.where("prompt_id <> 3")).collect()}
    assert answers[0] == "0/10" and answers[24] == "24/5" and answers[3] == ""


def test_append_and_truncate(spark):
    assert one(spark, A.append_once(F.col("a"), 0), a=[1, 0]) == [1, 0]
    assert one(spark, A.append_once(F.col("a"), 0), a=[1]) == [1, 0]
    empty = spark.range(1).select(A.append_once(F.array().cast("array<int>"), 0).alias("o")).first()["o"]
    assert empty == [0]
    assert one(spark, A.truncate(F.col("a"), 2, "left"), a=[1, 2, 3]) == [2, 3]
    assert one(spark, A.truncate(F.col("a"), 5, "left"), a=[1, 2, 3]) == [1, 2, 3]


def test_labels_are_shifted_and_ignored(spark):
    df = spark.createDataFrame([([5, 6, 1], [False, True, True], True), ([5, 6, 7], [True] * 3, False)], "i array<int>, m array<boolean>, ok boolean")
    got = df.select(A.shifted_labels(F.col("i"), F.col("m"), A.attention(F.col("i"), 1), F.col("ok")).alias("l")).collect()
    assert [r["l"] for r in got] == [[6, -100], [-100, -100]]


def test_attention_accepts_pad_zero(spark):
    assert one(spark, A.attention(F.col("a"), 0), a=[0, 3]) == [0, 1]
    with pytest.raises(ValueError):
        A.attention(F.lit(1), None)


def test_unknown_roles_stop_the_job(spark):
    df = spark.createDataFrame([([("robot", "x")],)], "conversations array<struct<`from`:string,value:string>>")
    with pytest.raises(Exception, match="unknown role"):
        normalize.remap_roles(df).collect()


def test_duplicate_options_give_the_first_letter(spark):
    df = spark.createDataFrame([(1, "q", ["x", "x", "x", "x"], 2)], "k bigint, q string, c array<string>, a int")
    row = normalize.mc_to_chat(df, 1, "k", "q", "c", "a").first()
    assert "A" in row["answer_text"].replace("After analysis, the", "") and "A. x\nB. x" in row["question_text"]


def test_fill_does_not_scan_inserted_text(spark):
    got = spark.range(1).select(normalize.fill("<{a}|{b}>", {"a": F.lit("{b}"), "b": F.lit("B")}).alias("o")).first()["o"]
    assert got == "<{b}|B>"


def test_strip_knows_more_than_blanks(spark):
    assert one(spark, strip(F.col("t")), t="\n\t a b \r\n") == "a b"


def test_incomplete_documents_are_skipped(spark):
    scores = spark.createDataFrame([(1, 0, 1.0), (1, 2, 2.0), (2, 0, 1.0), (2, 1, 2.0)], "doc_id bigint, cont_id bigint, score double")
    assert [r["doc_id"] for r in E.complete_docs(scores).collect()] == [2]
    assert [tuple(r) for r in E.choose(scores).collect()] == [(2, 1)]


def test_choice_ties_and_f1(spark):
    scores = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0)], "doc_id bigint, cont_id bigint, score double")
    chosen = E.choose(scores)
    assert chosen.first()["choice"] == 0
    wrong = chosen.withColumn("choice", F.lit(1).cast("bigint"))
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, label_id bigint")
    assert E.choice_f1(wrong, labels).first()["value"] == 0.0
    assert E.choice_accuracy(wrong, labels).first()["value"] == 1.0


def test_registry_of_tasks():
    assert len(tasks.TASKS) == 39
    assert len(tasks.SUBJECT_FIELD) == 57
    assert sum(len(tasks.subjects_of(c)) for c in tasks.CATEGORY_FIELDS) == 57
    assert tasks.subjects_of("anatomy") == ["anatomy"] and "machine_learning" in tasks.subjects_of("computer science")


def prompt(spark, task, **fields):
    df = spark.range(1)
    for k, v in fields.items():
        df = df.withColumn(k, v if not isinstance(v, (str, int, bool)) else F.lit(v))
    return tasks.task_prompts(df, task, ["id"]).first()


def test_hellaswag_like_prompt(spark):
    row = prompt(spark, "hellaswag", activity_label="Roof", ctx_a="A man. [x] sits", ctx_b="he Said", endings=F.array(F.lit("goes [title] on")), label="3")
    assert row["ctx_text"] == "Roof: A man. sits He said" and row["dc_text"] == "He said"
    assert row["continuations"] == [" goes. on"] and row["label_id"] == 3


def test_other_prompts(spark):
    row = prompt(spark, "copa", premise="It rained. ", question="cause", choice1="The sky", choice2="A dog", label=1)
    assert row["ctx_text"] == "It rained because" and row["continuations"] == [" the sky", " a dog"]
    row = prompt(spark, "boolq", passage="P", question="q", answer=True)
    assert row["label_id"] == 0 and row["ctx_text"] == "P\nQuestion: q?\nAnswer:"
    row = prompt(spark, "arc_easy", question="q", choices=F.array(F.lit("x"), F.lit("y")), answerKey="2")
    assert row["label_id"] == 1
    row = prompt(spark, "sst2", sentence='does n\'t " work " .', label=1)
    assert row["ctx_text"].startswith('doesn\'t"work".')


def test_pair_contexts(spark):
    df = spark.createDataFrame([(1, "Ann told _ that _ won.", "Bo", "Cy", "2")], "k bigint, sentence string, option1 string, option2 string, answer string")
    row = tasks.pair_context_prompts(df, ["k"]).first()
    assert row["ctx_texts"] == ["Ann told Bo", "Ann told Cy"] and row["continuation_text"] == " that _ won." and row["label_id"] == 1


def test_swapped_registry_row(spark):
    plain = {r["benchmark"]: r["metric"] for r in E.benchmark_registry(spark, E.INSTRUCT).collect()}
    fixed = {r["benchmark"]: r["metric"] for r in E.benchmark_registry(spark, E.INSTRUCT, turn_back=True).collect()}
    assert plain["BBH"] == "bbh:cot-v1::tulu" and fixed["BBH"] == "exact_match"
    assert {b: m for b, m in plain.items() if b != "BBH"} == {b: m for b, m in fixed.items() if b != "BBH"}


def test_nan_loss_stops(spark):
    df = spark.createDataFrame([("a", float("nan"))], "label string, loss double")
    with pytest.raises(Exception, match="NaN"):
        E.perplexity_by_label(df).collect()


def test_batch_accuracy_is_of_means(spark):
    pairs = spark.createDataFrame([(1, 9.0, 0.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0, 0.0)],
                                  "batch_id bigint, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")
    row = T.preference_rewards(pairs, 0.1).first()
    assert row["accuracy"] == 1.0 and row["pair_accuracy"] == 0.5


def test_strict_validation_stops(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert quality.violations(df, {"a_is_one": F.col("a") == 1}).first()["n_violations"] == 1
    with pytest.raises(Exception, match="a_is_one"):
        quality.violations(df, {"a_is_one": F.col("a") == 1}, strict=True).collect()
