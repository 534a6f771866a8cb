"""Evaluation requests around a model, and the metrics of what comes back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import arrays as A
from millrace.operators.prefix import dense_position
from millrace.operators.tasks import CATEGORY_FIELDS, SUBJECT_FIELD, TASKS, VARIANTS, multi_subject_example, subjects_of
from millrace.operators.tokenize import PAD, Vocabulary

CTX_LEN = 2048  # fixed value: longest query a model takes


# --- requests --------------------------------------------------------------------------


def _lengths(requests: DataFrame, model_ctx_len: int, cut_moves_context: bool) -> DataFrame:
    n_cont = F.size("continuation")
    less_last = F.slice(F.col("continuation"), F.lit(1), F.greatest(n_cont - 1, F.lit(0)))
    query = A.truncate(F.concat(F.col("ctx"), less_last), model_ctx_len, "left")
    sized = requests.withColumn("query", query).withColumn("dc_query", F.concat(F.col("dc"), less_last))
    ctx_len = F.size("query") - n_cont + 1 if cut_moves_context else F.size("ctx")
    return (
        sized.withColumn("ctx_len", ctx_len.cast("bigint"))
        .withColumn("dc_len", F.size("dc").cast("bigint"))
        .withColumn("cont_len", n_cont.cast("bigint"))
        .withColumn("cont_str_len", (F.length("continuation_text") - 1).cast("bigint"))
    )


def expand_requests(
    prompts: DataFrame, vocab: Vocabulary, doc: str = "doc_id", model_ctx_len: int = CTX_LEN
) -> DataFrame:
    """One row per (doc, continuation): token ids, lengths and the query a model sees.

    Context and conditional are encoded once per document, before the continuations fan out.
    The query lacks the continuation's last token and keeps its last ``model_ctx_len``.
    """
    encoded = prompts.withColumn("ctx", vocab.encode("ctx_text")).withColumn("dc", vocab.encode("dc_text"))
    rows = encoded.select(
        doc, "label_id", "ctx", "dc", F.posexplode("continuations").alias("cont_id", "continuation_text")
    ).withColumn("cont_id", F.col("cont_id").cast("bigint"))
    rows = rows.withColumn("continuation", vocab.encode("continuation_text"))
    return _lengths(rows, model_ctx_len, cut_moves_context=True)


def pair_context_requests(
    prompts: DataFrame, vocab: Vocabulary, doc: str = "doc_id", model_ctx_len: int = CTX_LEN
) -> DataFrame:
    """One row per (doc, context). Cutting the query does not change ctx_len here."""
    encoded = prompts.withColumn("continuation", vocab.encode("continuation_text"))
    zipped = encoded.select(
        doc, "label_id", "continuation", "continuation_text",
        F.posexplode(F.arrays_zip("ctx_texts", "dc_texts")).alias("cont_id", "c"),
    )
    rows = zipped.select(
        doc, "label_id", F.col("cont_id").cast("bigint").alias("cont_id"), "continuation", "continuation_text",
        vocab.encode(F.col("c.ctx_texts")).alias("ctx"), vocab.encode(F.col("c.dc_texts")).alias("dc"),
    )
    return _lengths(rows, model_ctx_len, cut_moves_context=False)


def pad_requests(
    requests: DataFrame,
    batch: str,
    fields: Sequence[str] = ("ctx", "continuation", "query", "dc_query"),
    model_ctx_len: int = CTX_LEN,
) -> DataFrame:
    """Pad every token array to its batch's longest.

    A longer array than the model takes keeps its tail; padding beyond that is cut off. A
    batch is a device batch, so its window is bounded by the batch size.
    """
    window = Window.partitionBy(batch)
    out = requests
    for name in fields:
        longest = F.max(F.size(name)).over(window)
        out = out.withColumn(f"__max_{name}", longest)
    for name in fields:
        ids = F.col(name)
        filled = A.truncate(A.pad(ids, F.col(f"__max_{name}"), F.lit(PAD)), model_ctx_len)
        out = out.withColumn(
            name, F.when(F.size(ids) > model_ctx_len, A.truncate(ids, model_ctx_len, "left")).otherwise(filled)
        ).drop(f"__max_{name}")
    return out


# --- few-shot prompts over subjects ----------------------------------------------------


def category_subjects(spark, names: Sequence[str]) -> DataFrame:
    """(name, ordinal, subject) for categories, fields or subjects."""
    rows = [(n, i, s) for n in names for i, s in enumerate(subjects_of(n))]
    return spark.createDataFrame(rows, "name string, ordinal bigint, subject string")


def category_table(spark) -> DataFrame:
    """(category, field, subject) by joining the two fixed tables."""
    fields = spark.createDataFrame(list(CATEGORY_FIELDS.items()), "category string, fields array<string>")
    subjects = spark.createDataFrame(list(SUBJECT_FIELD.items()), "subject string, field string")
    return fields.select("category", F.explode("fields").alias("field")).join(subjects, "field")


def fewshot_shots(
    dev: DataFrame, shots: int, lettered: bool, subject: str = "subject", order: str = "doc_key"
) -> DataFrame:
    """(subject, shots): the first dev questions with their answers, in dev order.

    The limit per subject is applied before the shuffle; a subject is aggregated once, not
    once per question that uses it.
    """
    place = F.row_number().over(Window.partitionBy(subject).orderBy(order))
    first = dev.withColumn("__place", place).where(F.col("__place") <= shots)
    letter = F.substring(F.lit("ABCD"), (F.col("answer") + 1).cast("int"), F.lit(1))
    told = letter if lettered else F.element_at("choices", (F.col("answer") + 1).cast("int"))
    shown = F.concat(
        multi_subject_example(F.col("question"), F.col("choices"), lettered), F.lit(" "), told, F.lit("\n\n")
    )
    ordered = F.array_sort(F.collect_list(F.struct("__place", shown.alias("shown"))))
    return first.groupBy(subject).agg(F.transform(ordered, lambda x: x["shown"]).alias("shots"))


def instruction_line(subject: Column) -> Column:
    # fixed value: the sentence that opens an instructed prompt
    return F.concat(
        F.lit("The following are multiple choice questions (with answers) about "),
        F.replace(subject, F.lit("_"), F.lit(" ")),
        F.lit(":\n\n"),
    )


def fewshot_join(
    questions: DataFrame, dev: DataFrame, shots: int = 5, lettered: bool = True, instructed: bool = True
) -> DataFrame:
    """Each question's context with its subject's examples in front; none is fine."""
    joined = questions.join(fewshot_shots(dev, shots, lettered), "subject", "left")
    bare = multi_subject_example(F.col("question"), F.col("choices"), lettered)
    lead = instruction_line(F.col("subject")) if instructed else F.lit("")
    return joined.withColumn("ctx_text", F.concat(lead, F.coalesce(F.array_join("shots", ""), F.lit("")), bare)).drop("shots")


def prompt_variants(
    questions: DataFrame, dev: DataFrame, variations: int | None, lettered: bool = False, key: str = "doc_key"
) -> DataFrame:
    """Every question under every prompt variant; doc_id advances per (question, variant).

    The variants are a handful of literals, so they fan out in place instead of joining.
    """
    variants = VARIANTS[variations]
    shots = [int(v.split("+")[1]) if v and "+" in v else 0 for v in variants]
    most = max(shots)
    placed = dense_position(questions, key, out="__place")
    if most:
        placed = placed.join(fewshot_shots(dev, most, lettered, order=key), "subject", "left")
    else:
        placed = placed.withColumn("shots", F.lit(None).cast("array<string>"))
    table = F.array(*[
        F.struct(
            F.lit(i).cast("bigint").alias("no"),
            F.lit(v).cast("string").alias("variant"),
            F.lit(bool(v and "inst" in v)).alias("inst"),
            F.lit(n).alias("shots"),
        )
        for i, (v, n) in enumerate(zip(variants, shots))
    ])
    every = placed.withColumn("v", F.explode(table))
    shots_text = F.coalesce(F.array_join(F.slice("shots", F.lit(1), F.col("v.shots")), ""), F.lit(""))
    lead = F.when(F.col("v.inst"), instruction_line(F.col("subject"))).otherwise(F.lit(""))
    bare = multi_subject_example(F.col("question"), F.col("choices"), lettered)
    return (
        every.withColumn("doc_id", (F.col("__place") * len(variants) + F.col("v.no")).cast("bigint"))
        .withColumn("variant", F.coalesce(F.col("v.variant"), F.lit("plain")))
        .withColumn("ctx_text", F.concat(lead, shots_text, bare))
        .drop("__place", "shots", "v")
    )


def subject_task_prompts(questions: DataFrame, dev: DataFrame, task: str, key: str = "doc_key") -> DataFrame:
    """(doc_id, variant, ctx_text, continuations, label_id, dc_text) of a subject task by name.

    The name says which subjects (``subject``) and which part (``split``) of the questions it
    takes, under which prompt variants, and whether options are lettered.
    """
    spec = TASKS[task]
    chosen = questions.where(F.col("subject").isin(subjects_of(spec.options["category"])) & (F.col("split") == spec.options["split"]))
    lettered = bool(spec.options.get("lettered"))
    every = prompt_variants(chosen, dev, spec.options.get("variants"), lettered, key)
    parts = spec.build(lambda name: F.col(name), lettered=lettered)
    return every.select(
        "doc_id", "variant", "ctx_text", parts.continuations.alias("continuations"),
        parts.label.cast("bigint").alias("label_id"), parts.conditional.alias("dc_text"),
    )


def subject_tasks(spark, names: Sequence[str]) -> DataFrame:
    """A row per task and prompt variant: (category, split, task, lettered, n, no, variant, inst, shots)."""
    rows = []
    for name in names:
        options = TASKS[name].options
        variants = VARIANTS[options.get("variants")]
        for no, (v, shots) in enumerate(zip(variants, _shots_of(name))):
            rows.append((options["category"], options["split"], name, bool(options.get("lettered")), len(variants), no,
                         v or "plain", bool(v and "inst" in v), shots))
    kind = "category string, split string, task string, lettered boolean, n int, no int, variant string, inst boolean, shots int"
    return spark.createDataFrame(rows, kind)


def all_subject_prompts(questions: DataFrame, dev: DataFrame, names: Sequence[str], key: str = "doc_key") -> DataFrame:
    """``subject_task_prompts`` of several names in one plan, with ``task``.

    Questions meet the categories of their subject, get their place there and their subject's examples
    once, and then one fixed table of tasks and variants. ``key`` is unique.
    """
    builds = {TASKS[name].build for name in names}
    if len(builds) != 1:
        raise ValueError("the tasks build their prompts in different ways")
    spark, (build,) = questions.sparkSession, builds
    tasks = subject_tasks(spark, names)
    categories = category_subjects(spark, sorted({TASKS[name].options["category"] for name in names}))
    categories = F.broadcast(categories.select(F.col("name").alias("category"), "subject"))  # fixed tables, not data
    # a place is told by the key alone, so texts stay out of the windows
    places = dense_position(
        questions.select(key, "subject", "split").join(categories, "subject").select(key, "category", "split"), key, by=["category", "split"], out="__place"
    ).drop("split")
    most = max(shots for name in names for shots in _shots_of(name))
    told = [fewshot_shots(dev, max(most, 1), lettered, order=key).withColumnRenamed("shots", f"__shots{int(lettered)}") for lettered in (False, True)]
    asked = questions.join(places, key).join(told[0], "subject", "left").join(told[1], "subject", "left")
    every = asked.join(F.broadcast(tasks), ["category", "split"])
    plain, lettered = (build(lambda name: F.col(name), lettered=x) for x in (False, True))
    either = lambda a, b: F.when(F.col("lettered"), b).otherwise(a)
    examples = F.slice(either(F.col("__shots0"), F.col("__shots1")), F.lit(1), F.col("shots"))
    lead = F.when(F.col("inst"), instruction_line(F.col("subject"))).otherwise(F.lit(""))
    return every.select(
        "task", (F.col("__place") * F.col("n") + F.col("no")).cast("bigint").alias("doc_id"), "variant",
        F.concat(lead, F.coalesce(F.array_join(examples, ""), F.lit("")), either(plain.text, lettered.text)).alias("ctx_text"),
        either(plain.continuations, lettered.continuations).alias("continuations"),
        plain.label.cast("bigint").alias("label_id"), plain.conditional.alias("dc_text"),
    )


def _shots_of(name: str) -> list[int]:
    return [int(v.split("+")[1]) if v and "+" in v else 0 for v in VARIANTS[TASKS[name].options.get("variants")]]


# --- scores ----------------------------------------------------------------------------

KEY = ("doc_id", "cont_id")


def continuation_loglik(logprobs: DataFrame, keys: Sequence[str] = KEY, value: str = "logprob") -> DataFrame:
    """Sum of token log-probabilities per continuation."""
    return logprobs.groupBy(*keys).agg(F.sum(value).alias("score"))


def length_normalised_loglik(
    logprobs: DataFrame, requests: DataFrame, keys: Sequence[str] = KEY, negate: bool = False
) -> DataFrame:
    """The sum over the continuation's characters; negated it is a cross entropy."""
    sums = continuation_loglik(logprobs, keys)
    scored = sums.join(requests.select(*KEY, "cont_str_len"), list(KEY))
    score = F.col("score") / F.col("cont_str_len")
    return scored.withColumn("score", -score if negate else score).drop("cont_str_len")


def domain_conditional_loglik(logprobs: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Ratio of the sum to the sum under the conditional prompt, in one aggregation."""
    return logprobs.groupBy(*keys).agg((F.sum("logprob") / F.sum("dc_logprob")).alias("score"))


def dedup_first(scores: DataFrame, value: str = "score", arrival: str = "arrival", keys: Sequence[str] = KEY) -> DataFrame:
    """One value per key: the one that arrived first."""
    return scores.groupBy(*keys).agg(F.min_by(value, arrival).alias(value))


def complete_docs(scores: DataFrame, doc: str = "doc_id", cont: str = "cont_id") -> DataFrame:
    """Documents none of whose continuation numbers reaches their count.

    A gap in the middle is noticed, a missing tail is not.
    """
    return scores.groupBy(doc).agg(F.max(cont).alias("__max"), F.count(F.lit(1)).alias("n_conts")).where(
        F.col("__max") < F.col("n_conts")
    ).drop("__max")


def choose(scores: DataFrame, doc: str = "doc_id", cont: str = "cont_id", by: Sequence[str] = ()) -> DataFrame:
    """The best continuation of every complete document; ties go to the lowest number."""
    best = scores.groupBy(doc, *by).agg(
        F.max_by(cont, F.struct(F.col("score"), -F.col(cont))).alias("choice"),
        F.max(cont).alias("__max"),
        F.count(F.lit(1)).alias("__n"),
    )
    return best.where(F.col("__max") < F.col("__n")).drop("__max", "__n")


def choice_accuracy(choices: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of (choice = label)."""
    joined = choices.join(labels, "doc_id")
    hit = (F.col("choice") == F.col("label_id")).cast("double")
    return joined.groupBy(*by).agg(F.avg(hit).alias("value"), F.count(F.lit(1)).alias("n_docs"))


def choice_f1(choices: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1 with class 0 positive; 0 when there is nothing positive."""
    joined = choices.join(labels, "doc_id")
    said, meant = F.col("choice") == 0, F.col("label_id") == 0

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    counted = joined.groupBy(*by).agg(
        count(said & meant).alias("tp"), count(said & ~meant).alias("fp"), count(~said & meant).alias("fn")
    )
    bottom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    value = F.when(bottom == 0, F.lit(0.0)).otherwise(2 * F.col("tp") / bottom)
    return counted.select(*by, "tp", "fp", "fn", value.alias("value"))


def answer_ce(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean score of continuation 0."""
    return scores.where(F.col("cont_id") == 0).groupBy(*by).agg(
        F.avg("score").alias("value"), F.count(F.lit(1)).alias("n_docs")
    )


def metric_name(label: str, metric: str) -> str:
    """Long-form key of a task's metric."""
    folder = "downstream_ce_loss" if metric == "ce_loss" else "downstream"
    return f"eval/{folder}/{label}_{metric}"


def label_metric_router(losses: DataFrame, label: str = "label") -> DataFrame:
    """Every instance loss to the metric of its label: sum and weight so far."""
    return losses.groupBy(label).agg(F.sum("loss").alias("total"), F.count(F.lit(1)).alias("weight"))


def perplexity_by_label(losses: DataFrame, label: str = "label") -> DataFrame:
    """(metric, value): mean loss and its exponential; a NaN loss stops the job."""
    checked = F.when(F.isnan("loss"), F.raise_error(F.lit("NaN loss")).cast("double")).otherwise(F.col("loss"))
    means = losses.groupBy(label).agg(F.avg(checked).alias("ce"))
    pairs = F.array(
        F.struct(F.concat(F.lit("eval/"), label, F.lit("/CrossEntropyLoss")).alias("metric"), F.col("ce").alias("value")),
        F.struct(F.concat(F.lit("eval/"), label, F.lit("/Perplexity")).alias("metric"), F.exp("ce").alias("value")),
    )
    return means.select(F.inline(pairs))


def instance_loss(tokens: DataFrame, key: str = "instance_id", loss: str = "loss") -> DataFrame:
    """Mean over positions; an ignored position adds nothing and still counts."""
    return tokens.groupBy(key).agg(F.avg(F.coalesce(F.col(loss), F.lit(0.0))).alias("loss"))


ANSWER_FORMAT = r"Therefore, the answer is \(([A-D])\)"  # fixed value


def extract_choice(responses: DataFrame, text: str = "response", gold: str = "gold") -> DataFrame:
    """The stated letter ("" when none is stated) and whether it is the gold one."""
    return responses.withColumn("extracted", F.regexp_extract(text, ANSWER_FORMAT, 1)).withColumn(
        "match", (F.col("extracted") == F.col(gold)).cast("bigint")
    )


def instruction_levels(checks: DataFrame, prompt: str = "prompt_id") -> DataFrame:
    """(metric, value): accuracy per prompt and per instruction, strict and loose.

    A prompt passes when all its instructions do.
    """
    per_prompt = checks.groupBy(prompt).agg(
        F.bool_and("strict").alias("all_strict"),
        F.bool_and("loose").alias("all_loose"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("strict"), 1)).alias("n_strict"),
        F.count(F.when(F.col("loose"), 1)).alias("n_loose"),
    )
    totals = per_prompt.agg(
        F.avg(F.col("all_strict").cast("double")).alias("prompt_level_strict_acc"),
        F.avg(F.col("all_loose").cast("double")).alias("prompt_level_loose_acc"),
        (F.sum("n_strict") / F.sum("n")).alias("inst_level_strict_acc"),
        (F.sum("n_loose") / F.sum("n")).alias("inst_level_loose_acc"),
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in totals.columns])
    return totals.select(F.inline(pairs))


# Benchmark, shots, primary metric, alias. The BBH row of the second table has
# metric and alias the other way round; ``benchmark_registry`` can turn it back.
PRETRAINED = [
    ("ARC Challenge", 0, "acc_uncond", "arc_challenge::olmo1"),
    ("ARC Easy", 0, "acc_uncond", "arc_easy::olmo1"),
    ("BoolQ", 0, "acc_raw", "boolq::olmo1"),
    ("Hellaswag", 0, "acc_per_token", "hellaswag::olmo1"),
    ("PIQA", 0, "acc_per_token", "piqa::olmo1"),
    ("SciQ", 0, "acc_raw", "sciq::olmo1"),
    ("Winogrande", 0, "acc_per_token", "winogrande::olmo1"),
    ("OpenBookQA", 0, "acc_uncond", "openbookqa"),
    ("MMLU", 5, "acc_raw", "mmlu:mc::olmes"),
    ("BBH", 3, "exact_match", "bbh:cot-v1::olmes"),
    ("GSM8k", 8, "exact_match", "gsm8k::olmes"),
]
INSTRUCT = [
    ("MMLU", 5, "acc_raw", "mmlu:mc::tulu"),
    ("TruthfulQA", 6, "mc2", "truthfulqa::tulu"),
    ("BBH", 3, "bbh:cot-v1::tulu", "exact_match"),
    ("GPQA", 0, "exact_match", "gpqa:0shot_cot::llama3.1"),
    ("GSM8k", 8, "exact_match", "gsm8k::tulu"),
    ("Minerva MATH", 0, "exact_match_flex", "minerva_math::llama3.1"),
    ("IFEval", 0, "prompt_level_loose_acc", "ifeval::tulu"),
    ("Alpaca", 0, "length_controlled_winrate", "alpaca_eval_v2::tulu"),
]


def benchmark_registry(spark, rows: Sequence[tuple], turn_back: bool = False) -> DataFrame:
    """(benchmark, shots, metric, alias); ``turn_back`` repairs a swapped row."""
    fixed = [(b, s, a, m) if turn_back and "::" in m else (b, s, m, a) for b, s, m, a in rows]
    return spark.createDataFrame(fixed, "benchmark string, shots bigint, metric string, alias string")


def benchmark_summary(results: DataFrame, registry: DataFrame, benchmarks: Sequence[str]) -> DataFrame:
    """One row per model: each benchmark's primary metric at its shots, and their mean."""
    primary = results.join(registry, ["alias", "metric", "shots"])
    wide = primary.groupBy("model").pivot("benchmark", list(benchmarks)).agg(F.avg("value"))
    filled = [F.col(f"`{b}`") for b in benchmarks]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in filled), F.lit(0.0))
    present = sum((c.isNotNull().cast("int") for c in filled), F.lit(0))
    return wide.withColumn("mean", total / F.when(present > 0, present))
