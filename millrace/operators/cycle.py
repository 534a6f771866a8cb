"""The cycle that finds programs for cases: mask, write a program, run it, score it, try again.

Each case is masked once per outer round and asked for a program in every inner one; a case is solved
when a program gives its answer. Masks and rounds are committed tables that hold what they add: a round
has the programs of its outer round alone, and earlier attempts are put together once, at the end. So the
tables grow with the rounds and not with their square, and a job that was killed goes on after its last
committed table with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import to_float
from millrace.operators import quality
from millrace.operators.synthetic import (
    clean_program, fewshot_messages, gold_number, join_responses, parse_masking_response, program_prompts,
)
from millrace.sources.commits import CommitLog

# What an outer round leaves behind when its case is masked anew.
ARCHIVED = ("masked_question", "replacement", "parameters", "programs", "results", "correct")
# (kind, number of the round, prompts as (case_id, prompt)) to (case_id, response)
Model = Callable[[str, int, DataFrame], DataFrame]
# (number of the round, calls as (case_id, program, parameters)) to (case_id, result)
Runner = Callable[[int, DataFrame], DataFrame]


def solve_cases(cases: DataFrame, log: CommitLog, model: Model, runner: Runner, outer: int = 30, inner: int = 5, seed: int = 96) -> DataFrame:
    """(case_id, question, answer, masked_question, replacement, parameters, programs, results, correct, prev, round, solved).

    ``cases`` has (case_id, question, answer) and a unique ``case_id``. ``correct`` is the share in per cent of
    the outer round's programs that give the last number of the answer; a case is solved when
    it is above zero, and otherwise has the state of the last round. ``prev`` keeps the fields of earlier
    outer rounds. Programs that would never end are not run. A response or result that is
    missing is an empty text. The driver sees a line per table and whether a case is open.
    """
    mask_log = CommitLog(log.spark, f"{log.folder}/masks")
    done, masks_done = log.commits(), mask_log.commits()
    # made once, as it has many parts; a prompt's examples are drawn by case and round
    prompt = program_prompts(F.col("question"), F.col("replacement"), seed, F.concat_ws(":", "case_id", "round")).alias("prompt")
    first = masked = still_open = None
    for number in range(outer * inner):
        turn, again = divmod(number, inner)
        if not again:
            if turn in masks_done:
                masked = mask_log.read(masks_done[turn])
            else:
                asked = cases if first is None else _matched(quality.select_unsolved(still_open, []).select("case_id"), first, "question", "answer")
                masked = mask_log.write(turn, _mask(asked, turn, number, model))
            first = masked if first is None else first
        if number in done:
            state = log.read(done[number])
        else:
            tried = still_open.withColumn("round", F.col("round") + 1) if again else _begin(masked, inner)
            state = log.write(number, _round(tried, masked, number, prompt, model, runner))
        still_open = state.where(~F.col("solved"))
        if number + 1 not in done and still_open.isEmpty():
            break
    return _attempts(log, mask_log, number, inner)


def _matched(rows: DataFrame, masked: DataFrame, *columns: str, by: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """``rows`` with columns of their masks; a null id is an id."""
    right = masked.select(*[F.col(key).alias(f"__{key}") for key in by], *columns)
    same = F.lit(True)
    for key in by:
        same = same & F.col(key).eqNullSafe(F.col(f"__{key}"))
    return rows.join(right, same).drop(*[f"__{key}" for key in by])


def _mask(cases: DataFrame, turn: int, number: int, model: Model) -> DataFrame:
    prompts = cases.select("case_id", fewshot_messages(F.col("question")).alias("prompt"))
    answered = join_responses(cases.select("case_id", "question", "answer"), model("mask", number, prompts), "case_id")
    return parse_masking_response(answered).select(
        "case_id", "question", "answer", "masked_question", "replacement", "parameters", F.lit(turn).alias("turn")
    )


def _begin(masked: DataFrame, inner: int) -> DataFrame:
    none = F.array().cast("array<string>")
    return masked.select(
        "case_id", gold_number(F.col("answer")).alias("gold"), "parameters", none.alias("programs"), none.alias("results"),
        (F.col("turn") * F.lit(inner).cast("bigint")).alias("round"),
    )


def _round(tried: DataFrame, masked: DataFrame, number: int, prompt: Column, model: Model, runner: Runner) -> DataFrame:
    """Open cases after one more program each."""
    prompts = _matched(tried.select("case_id", "round"), masked, "question", "replacement").select("case_id", prompt)
    tried = join_responses(tried, model("program", number, prompts), "case_id").withColumn("program", clean_program(F.col("response")))
    calls = tried.where(~quality.is_dead_loop(F.col("program"))).select("case_id", "program", "parameters")
    returned = runner(number, calls).select("case_id", F.col("result").alias("__result"))
    tried = tried.join(returned, "case_id", "left").withColumns({
        "programs": F.array_append("programs", F.col("program")),
        "results": F.array_append("results", F.coalesce("__result", F.lit(""))),
    })
    correct = _share(F.col("results"), F.col("gold"))
    return tried.select("case_id", "gold", "parameters", "programs", "results", correct.alias("correct"), "round", (correct > 0).alias("solved"))


def _attempts(log: CommitLog, mask_log: CommitLog, last: int, inner: int) -> DataFrame:
    """Every case as its last round left it, with its earlier attempts in their order."""
    done, masks_done = log.commits(), mask_log.commits()
    rounds = log.read(*[done[n] for n in range(last + 1)]).withColumn("turn", F.floor(F.col("round") / inner).cast("int"))
    masks = mask_log.read(*[masks_done[n] for n in range(last // inner + 1)])
    by = ("case_id", "turn")
    over = F.col("solved") | (F.col("round") == last)
    ended = _matched(rounds.where(over), masks, "question", "answer", "masked_question", "replacement", by=by)
    left = _matched(rounds.where(~over & (F.col("round") % inner == inner - 1)), masks, "masked_question", "replacement", by=by)
    prev = left.groupBy(F.col("case_id").alias("__case")).agg(F.sort_array(F.collect_list(F.struct("turn", F.struct(*ARCHIVED).alias("was")))).alias("prev"))
    kept = F.transform(F.col("prev"), lambda x: x["was"])
    out = ended.join(prev, F.col("case_id").eqNullSafe(F.col("__case")), "left")
    return out.withColumn("prev", F.coalesce(kept, F.array().cast(prev.select(kept).schema[0].dataType))).select(
        "case_id", "question", "answer", *ARCHIVED, "prev", "round", "solved"
    )


def _share(results: Column, gold: Column) -> Column:
    hits = F.filter(results, lambda r: F.coalesce(to_float(r) == gold, F.lit(False)))
    return F.size(hits) * F.lit(100.0) / F.size(results)
