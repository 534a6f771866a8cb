"""Row predicates, row constraints and the repetition mask."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, functions as F

from millrace.functions.arrays import IGNORED
from millrace.functions.periods import longest_repetition


def has_labels(df: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Rows that kept a label after truncation.

    With an observation the number of removed rows is counted in the same pass.
    """
    if observation is not None:
        df = df.observe(observation, F.count(F.when(F.col("n_labels") <= 0, 1)).alias("removed"))
    return df.where(F.col("n_labels") > 0)


def pair_has_labels(df: DataFrame) -> DataFrame:
    """Pairs of which both sides kept a label."""
    def labelled(col: str) -> Column:
        return F.exists(col, lambda x: x != IGNORED)

    return df.where(labelled("chosen_labels") & labelled("rejected_labels"))


def repetition_mask(
    df: DataFrame, ids: str = "input_ids", min_period: int = 1, max_period: int = 13, max_count: int = 32
) -> DataFrame:
    """times is the most repetitions of any run of a short period, instance_mask false where
    they reach ``max_count``. Rows are masked, not removed.
    """
    counted = df.withColumn("times", longest_repetition(F.col(ids), min_period, max_period))
    return counted.withColumn("instance_mask", F.col("times") < F.lit(max_count))


def select_unsolved(cases: DataFrame, clear: list[str], rework: bool = False) -> DataFrame:
    """Cases whose ``correct`` is absent or zero.

    When they are masked anew, the present attempt goes to ``prev`` and its fields are cleared.
    """
    open_cases = cases.where(F.coalesce(F.col("correct"), F.lit(0.0)) <= 0)
    if not rework:
        return open_cases
    attempt = F.struct(*[F.col(c) for c in clear])
    out = open_cases.withColumn("prev", F.array_append("prev", attempt))
    for name in clear:
        out = out.withColumn(name, F.lit(None).cast(out.schema[name].dataType))
    return out


def select_usable_cases(cases: DataFrame, excluded: DataFrame, candidates: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases that are not excluded and have a candidate."""
    usable = cases.join(excluded.select(key), key, "left_anti")
    return usable.join(candidates.select(key).distinct(), key, "left_semi")


def is_dead_loop(program: Column) -> Column:
    return F.instr(program, "while True:") > 0


def violations(df: DataFrame, rules: Mapping[str, Column], strict: bool = False) -> DataFrame:
    """(rule, n_violations) for all rules in one pass; strict mode stops the job on any."""
    counted = df.agg(
        *[F.coalesce(F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)), F.lit(0)).alias(name) for name, ok in rules.items()]
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("bigint").alias("n_violations")) for n in rules])
    table = counted.select(F.explode(pairs).alias("r")).select("r.rule", "r.n_violations")
    if strict:
        fine = F.when(F.col("n_violations") == 0, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("rule violated: "), F.col("rule"))).cast("boolean")
        )
        table = table.where(fine)
    return table


def log_every_n(steps: DataFrame, *intervals: int, step: str = "step") -> DataFrame:
    """Steps divisible by any of the intervals."""
    keep = F.lit(False)
    for n in intervals:
        keep = keep | (F.col(step) % n == 0)
    return steps.where(keep)
