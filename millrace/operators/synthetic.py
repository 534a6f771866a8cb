"""Synthetic question-and-answer data: the table steps around a model and a program runner.

Prompts go out and responses come in as tables keyed by case (and slot); nothing here calls
a model or runs a program.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import prompt_texts as P
from millrace.functions.hashing import seeded_int, seeded_md5
from millrace.functions.text import last_number, last_token, strip, to_float, truncated
from millrace.operators.normalize import fill
from millrace.operators.quality import is_dead_loop

# How many accepted variants complete a case, and what stands in for the
# predictions of a case that has none.
QUOTA = 20
NO_PREDICTION = "-50000000"
NO_NUMBER = -50000000000.0


def _message(role: str, content: Column | str) -> Column:
    text = F.lit(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), text.alias("content"))


# --- prompts ---------------------------------------------------------------------------


def fewshot_messages(question: Column) -> Column:
    """System turn, the example turns, then the question."""
    shown = [_message("system", P.MASK_SYSTEM)]
    for asked, told in P.MASK_EXAMPLES:
        shown += [_message("user", asked), _message("assistant", told)]
    return F.array(*shown, _message("user", question))


def apply_replacements(question: Column, entries: Column, longest_first: bool = False) -> Column:
    """Replace every key by "label (code)", one after the other.

    Entries are taken in their own order, or by (length desc, key desc). A later key can hit
    text that an earlier one put in.
    """
    if longest_first:
        keyed = F.transform(
            entries, lambda e: F.struct(F.length(e["key"]).alias("n"), e["key"].alias("key"), e["label"].alias("label"), e["code"].alias("code"))
        )
        entries = F.reverse(F.array_sort(keyed))
    return F.aggregate(
        entries,
        question,
        lambda text, e: F.replace(text, e["key"], F.concat(e["label"], F.lit(" ("), e["code"], F.lit(")"))),
    )


def program_prompts(question: Column, entries: Column, seed: int, key: Column) -> Column:
    """System turn, the examples in drawn order with a drawn last answer, the masked question."""
    drawn = F.when(
        seeded_int(seed, F.lit("coin"), key) % 2 == 0, F.lit(P.PROGRAM_DRAWN_ANSWERS[0])
    ).otherwise(F.lit(P.PROGRAM_DRAWN_ANSWERS[1]))
    pairs = [(F.lit(q), F.lit(a)) for q, a in P.PROGRAM_EXAMPLES] + [(F.lit(P.PROGRAM_DRAWN_QUESTION), drawn)]
    shuffled = F.array_sort(F.array(*[
        F.struct(seeded_md5(seed, key, F.lit(i)).alias("h"), F.lit(i).alias("i"), q.alias("q"), a.alias("a"))
        for i, (q, a) in enumerate(pairs)
    ]))
    examples = F.flatten(F.transform(shuffled, lambda x: F.array(_message("user", x["q"]), _message("assistant", x["a"]))))
    masked = apply_replacements(question, entries, longest_first=True)
    return F.concat(F.array(_message("system", P.PROGRAM_SYSTEM)), examples, F.array(_message("user", masked)))


def model_prompt(template: str, **values: Column) -> Column:
    """System turn and a filled template."""
    return F.array(_message("system", P.HELPFUL), _message("user", fill(template, values)))


def perturb_prompt(question: Column, parameters: Column) -> Column:
    return model_prompt(P.PERTURB_PARAMETERS, question=question, parameters=parameters)


def rewrite_prompt(question: Column, parameters: Column, new_parameters: Column) -> Column:
    return model_prompt(
        P.REWRITE_QUESTION, question=question, parameters=parameters, new_parameters=F.array_join(new_parameters, "\n")
    )


def answer_prompt(question: Column, examples: bool = True) -> Column:
    template = P.ANSWER_QUESTION_WITH_EXAMPLES if examples else P.ANSWER_QUESTION
    return model_prompt(template, question=question)


# --- reading responses -----------------------------------------------------------------


def _after(lines: Column, start: str) -> Column:
    """The line after the last line that begins with ``start`` and is not the final one."""
    next_lines = F.transform(
        lines, lambda line, i: F.when(line.startswith(start) & (i < F.size(lines) - 1), F.element_at(lines, i + 2))
    )
    found = F.filter(next_lines, lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def parse_masking_response(df: DataFrame, response: str = "response", question: str = "question") -> DataFrame:
    """replacement entries, stated question, parameters and masked question of a response.

    A replacement is a line that begins with a quote, has exactly two quoted texts and a
    bracketed code. A repeated key keeps its first place and its last value. The question the
    model states is read but the masked question is made from the original.
    """
    out = df.withColumn("__lines", F.split(strip(F.col(response)), "\n"))
    quoted = F.filter("__lines", lambda line: line.startswith('"'))
    read = F.transform(
        quoted,
        lambda line: F.struct(
            F.regexp_extract_all(line, F.lit('"([^"]*)"'), F.lit(1)).alias("texts"),
            F.regexp_extract_all(line, F.lit(r'\([^"]*\)'), F.lit(0)).alias("codes"),
        ),
    )
    usable = F.filter(read, lambda x: (F.size(x["texts"]) == 2) & (F.size(x["codes"]) > 0))
    entries = F.transform(
        usable,
        lambda x: F.struct(
            strip(F.element_at(x["texts"], 1)).alias("key"),
            strip(F.element_at(x["texts"], 2)).alias("label"),
            F.regexp_replace(F.element_at(x["codes"], -1), r"^\(|\)$", "").alias("code"),
        ),
    )
    out = out.withColumn("__all", entries)
    keys = F.array_distinct(F.transform("__all", lambda e: e["key"]))
    kept = F.transform(keys, lambda k: F.element_at(F.filter("__all", lambda e: e["key"] == k), -1))
    return (
        out.withColumn("replacement", kept)
        .withColumn("stated_question", _after(F.col("__lines"), "So the question becomes"))
        .withColumn("parameters", _after(F.col("__lines"), "With parameters"))
        .withColumn("masked_question", F.nullif(apply_replacements(F.col(question), F.col("replacement")), F.lit("")))
        .drop("__lines", "__all")
    )


def clean_program(text: Column) -> Column:
    """From the first line that begins a function or a docstring to before the first line,
    that one included, with a closing remark or a code fence."""
    # a dot for every character is matched several times as fast as a class of all of them
    begun = F.regexp_extract(text, r"(?s)(?:^|\n)((?:def|''').*)", 1)
    return F.regexp_replace(begun, r"(?s)(?:^|\n)[^\n]*?(?:```|(?i:program ends)).*", "")


def _drop_heading(lines: Column) -> Column:
    """Six lines mean that the first is a heading."""
    return F.when(F.size(lines) == 6, F.slice(lines, 2, 5)).otherwise(lines)


def parse_parameter_lines(response: Column) -> Column:
    """New parameter lines. Leading numbers such as "1. " stay."""
    text = response
    for gone in ("Parameters:", "```", "- "):  # fixed values
        text = F.replace(text, F.lit(gone), F.lit(""))
    return _drop_heading(F.filter(F.split(strip(text), "\n"), lambda x: F.length(x) > 0))


def parse_question_lines(response: Column) -> Column:
    """New questions. Lines are dropped when empty before they are stripped."""
    lines = F.filter(F.split(response, "\n"), lambda x: F.length(x) > 0)
    return _drop_heading(F.transform(lines, strip))


def parse_answer(text: Column) -> Column:
    """Digits and dots of what follows the last "answer is", else of the last word."""
    tail = F.when(F.contains(text, F.lit("answer is")), strip(F.substring_index(text, "answer is", -1))).otherwise(
        F.substring_index(text, " ", -1)
    )
    return F.regexp_replace(F.regexp_replace(tail, r"\.$", ""), r"[^\d.]", "")


def gold_number(answer: Column) -> Column:
    """The last token of an answer as a number; "1,000" is not one."""
    return to_float(last_token(answer))


# --- candidates ------------------------------------------------------------------------


def append_candidates(attempts: DataFrame, returned: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, ordinal, program): this round's cleaned programs after those of earlier rounds."""
    so_far = attempts.groupBy(case).agg((F.max("ordinal") + 1).alias("__next"))
    new = returned.join(so_far, case, "left").select(
        case, F.coalesce("__next", F.lit(0)).cast("bigint").alias("ordinal"), clean_program(F.col("response")).alias("program")
    )
    return attempts.select(case, F.col("ordinal").cast("bigint").alias("ordinal"), "program").unionByName(new)


def score_candidates(candidates: DataFrame, cases: DataFrame, case: str = "case_id") -> DataFrame:
    """correct = 100 x matches / candidates; what cannot be read as a number is wrong."""
    gold = cases.select(case, gold_number(F.col("answer")).alias("__gold"))
    hit = F.coalesce(to_float("result") == F.col("__gold"), F.lit(False))
    return candidates.join(gold, case).groupBy(case).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        (F.count(F.when(hit, 1)) * 100 / F.count(F.lit(1))).alias("correct"),
    )


def first_correct_program(
    candidates: DataFrame, cases: DataFrame, case: str = "case_id", program: str = "program", clean: Callable[[Column], Column] | None = None
) -> DataFrame:
    """(case, ordinal, program): the first candidate whose rounded result is the rounded gold.

    Rounding is half to even. The program takes place 0 of its case, with an import in front
    when it uses the math module. Cases without a match are left out. ``clean`` makes the program of the
    text in ``program``; only texts that are chosen are cleaned.
    """
    gold = cases.select(case, F.bround(gold_number(F.col("answer"))).alias("__gold"))
    fits = candidates.join(gold, case).where(F.bround(to_float("result")) == F.col("__gold"))
    chosen = fits.groupBy(case).agg(F.min("ordinal").alias("ordinal"), F.min_by(program, "ordinal").alias("program"))
    if clean is not None:
        chosen = chosen.withColumn("program", clean(F.col("program")))
    imported = F.concat(F.lit("import math\n\n"), F.col("program"))
    return chosen.withColumn("program", F.when(F.contains("program", F.lit("math.")), imported).otherwise(F.col("program")))


def build_calls(cases: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, slot, parameter, call, dead_loop): one program-plus-call text per parameter line."""
    rows = cases.select(case, "program", F.posexplode("new_parameters").alias("slot", "parameter"))
    call = F.concat(F.col("program"), F.lit("\noutput = answer("), F.col("parameter"), F.lit(")\nprint(output)"))
    return rows.select(
        case, F.col("slot").cast("bigint").alias("slot"), "parameter", call.alias("call"), is_dead_loop(call).alias("dead_loop")
    )


def drop_dead_loops(calls: DataFrame) -> DataFrame:
    """Calls that may run."""
    return calls.where(~F.col("dead_loop"))


def dead_loop_counts(calls: DataFrame) -> DataFrame:
    """(n_calls, n_dead_loops): calls that may run, and the others, once per parameter set."""
    return calls.agg(
        F.count(F.when(~F.col("dead_loop"), 1)).alias("n_calls"), F.count(F.when(F.col("dead_loop"), 1)).alias("n_dead_loops")
    )


# --- variants --------------------------------------------------------------------------


def generate_responses(
    prompts: DataFrame, generate: Callable[[list[str]], list[str]], key: str = "prompt_id", text: str = "prompt", size: int = 1000
) -> DataFrame:
    """(key, response) from a function that answers a list of at most ``size`` prompts.

    The hook for an external model. Write the result before it is used twice: a model may
    answer differently when a task is repeated.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                yield part[[key]].assign(response=generate(part[text].tolist()))

    return prompts.select(key, text).mapInPandas(run, f"`{key}` {kind}, response string")


def join_responses(prompts: DataFrame, responses: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Each prompt with its response by key; a failed one is an empty text."""
    joined = prompts.join(responses.select(key, "response"), key, "left")
    return joined.withColumn("response", F.coalesce("response", F.lit("")))


def merge_retries(variants: DataFrame, retried: DataFrame, keys: Sequence[str] = ("case_id", "slot")) -> DataFrame:
    """Predictions with the retried ones put in; slots never answered are empty texts."""
    new = retried.select(*keys, F.col("response").alias("__new"))
    return variants.join(new, list(keys), "left").withColumn(
        "new_prediction", F.coalesce("__new", "new_prediction", F.lit(""))
    ).drop("__new")


def align_variants(cases: DataFrame, fields: Sequence[str], case: str = "case_id") -> DataFrame:
    """(case, slot, fields...): lists side by side, as long as the shortest. Row-local."""
    shortest = F.least(*[F.size(f) for f in fields]) if len(fields) > 1 else F.size(fields[0])
    zipped = F.slice(F.arrays_zip(*fields), F.lit(1), F.greatest(shortest, F.lit(0)))
    rows = cases.select(case, F.posexplode(zipped).alias("slot", "v"))
    return rows.select(case, F.col("slot").cast("bigint").alias("slot"), *[F.col("v")[f].alias(f) for f in fields])


def align_slots(*parts: DataFrame, keys: Sequence[str] = ("case_id", "slot")) -> DataFrame:
    """The same for parts in long form: slots that all parts have.

    All joins share their keys, so every part is shuffled once, and a case of any size is
    spread over its slots.
    """
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(keys))
    return out


def _equal_whole(prediction: Column, answer: Column) -> Column:
    return F.coalesce(truncated(prediction) == truncated(to_float(answer)), F.lit(False))


def verify_variants(variants: DataFrame) -> DataFrame:
    """Variants whose prediction's last number equals the answer, both cut to whole numbers."""
    return variants.where(_equal_whole(last_number("new_prediction"), F.col("new_answer")))


def generation_quota(accepted: DataFrame, cases: DataFrame, quota: int = QUOTA, case: str = "case_id") -> DataFrame:
    """(case, n_accepted, complete) for every case."""
    counts = accepted.groupBy(case).agg(F.count(F.lit(1)).alias("n_accepted"))
    joined = cases.select(case).join(counts, case, "left")
    n = F.coalesce("n_accepted", F.lit(0)).cast("bigint")
    return joined.select(case, n.alias("n_accepted"), (n >= quota).alias("complete"))


def quota_round(
    accepted: DataFrame, variants: DataFrame, cases: DataFrame, quota: int = QUOTA, case: str = "case_id"
) -> tuple[DataFrame, DataFrame]:
    """(accepted, open cases) after a round of variants.

    The round's verified variants are appended to those of the rounds before. A case that has
    its quota is cleared: its later variants do not count and it is not asked again.
    """
    done = generation_quota(accepted, cases, quota, case).where("complete").select(case)
    added = verify_variants(variants).join(done, case, "left_anti").select(*accepted.columns)
    after = accepted.unionByName(added)
    still_open = generation_quota(after, cases, quota, case).where(~F.col("complete")).drop("complete")
    return after, still_open


def select_retries(
    questions: DataFrame, predictions: DataFrame, answers: DataFrame, keys: Sequence[str] = ("case_id", "slot")
) -> DataFrame:
    """(case_id, slot, question) still to be answered.

    A case without any prediction compares a stand-in text, whose last number is 0, so an
    answer of 0 counts as right. Predictions of an earlier round are compared as they are.
    """
    case = keys[0]
    answered = predictions.select(case).distinct().withColumn("__has", F.lit(True))
    aligned = questions.join(answers, list(keys)).join(predictions, list(keys), "left").join(answered, case, "left")
    paired = aligned.where(F.col("new_prediction").isNotNull() | F.col("__has").isNull())
    said = F.coalesce("new_prediction", F.lit(NO_PREDICTION))
    right = _equal_whole(last_number(said, NO_NUMBER), F.col("new_answer"))
    return paired.where(~right).select(*keys, F.col("new_question").alias("question"))


def majority_answer(answers: DataFrame, case: str = "case_id", pos: str = "pos") -> DataFrame:
    """Most frequent parsed answer per case, ties to the one seen first."""
    counted = answers.withColumn("answer", parse_answer(F.col("response"))).groupBy(case, "answer").agg(
        F.count(F.lit(1)).alias("votes"), F.min(pos).alias("__first")
    )
    best = F.max_by(F.struct("answer", "votes"), F.struct(F.col("votes"), -F.col("__first")))
    return counted.groupBy(case).agg(best.alias("b")).select(case, "b.answer", "b.votes")


def iterative_rounds(
    cases: DataFrame,
    attempt: Callable[[DataFrame, int], DataFrame],
    rounds: int,
    stage: Callable[[DataFrame], DataFrame],
    case: str = "case_id",
) -> DataFrame:
    """(case, round, result) of the first attempt that solved each case.

    ``attempt`` returns the solved cases of a round among those still open. Each round's
    results are written and read back by ``stage``, so a lost executor never repeats a round;
    the loop ends when nothing is open. The driver sees one emptiness flag per round.
    """
    solved: DataFrame | None = None
    still_open = stage(cases)
    for number in range(rounds):
        got = stage(attempt(still_open, number).withColumn("round", F.lit(number).cast("bigint")))
        solved = got if solved is None else solved.unionByName(got)
        if number + 1 < rounds:
            still_open = stage(still_open.join(got.select(case), case, "left_anti"))
            if still_open.isEmpty():
                break
    return solved
