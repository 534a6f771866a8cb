"""Metrics of a training run: throughput, minima, early stop, loss and reward averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from millrace.operators.prefix import running_minimum, running_offsets, trailing_blocks

WINDOW = 100  # fixed value: default number of batches a throughput is taken over


def sliding_throughput(
    steps: DataFrame,
    window: int = WINDOW,
    by: Sequence[str] = ("rank",),
    step: str = "step",
    start: str = "start_s",
    check: str = "check_s",
    tokens: str = "tokens",
    reset: str = "reset",
) -> DataFrame:
    """tokens_per_second and batches_per_second over the last ``window`` recorded batches.

    The first batch of a run is not recorded. A reset empties the window after its step. The
    rate is over the time from the first start in the window to the check; it is NULL where
    nothing is recorded yet.
    """
    by = list(by)
    # resets strictly before a step number its segment; segments are contiguous in the run, so
    # blocks of run positions hold all of a window's batches
    weights = {"__pos": F.lit(1), "segment": F.col(reset).cast("int")}
    blocks = trailing_blocks(running_offsets(steps, step, weights, by=by), "__pos", window)
    frame = (
        Window.partitionBy(*by, "segment", "__block").orderBy("__pos").rowsBetween(-(window - 1), Window.currentRow)
    )
    recorded = F.col("__pos") > 0
    seconds = F.col(check) - F.col("__first")
    return (
        blocks.withColumn("__first", F.first(F.when(recorded, F.col(start)), ignorenulls=True).over(frame))
        .withColumn("window_tokens", F.sum(F.when(recorded, F.col(tokens))).over(frame).cast("bigint"))
        .withColumn("window_batches", F.nullif(F.count(F.when(recorded, 1)).over(frame), F.lit(0).cast("bigint")))
        .where(~F.col("__context"))
        .withColumn("tokens_per_second", F.try_divide(F.col("window_tokens"), seconds))
        .withColumn("batches_per_second", F.try_divide(F.col("window_batches"), seconds))
        .drop("__pos", "__block", "__context", "__first")
    )


def running_min_loss(steps: DataFrame, by: Sequence[str] = ("rank",), step: str = "step", loss: str = "loss") -> DataFrame:
    """The smallest loss so far, and the perplexity of the present one."""
    return running_minimum(steps, step, loss, by=by, out="min_loss").withColumn("perplexity", F.exp(loss))


def early_stop(
    steps: DataFrame,
    factor: float,
    warmup: int,
    interval: int,
    time_limit: float | None = None,
    extra_steps: int = 0,
    by: Sequence[str] = ("rank",),
    step: str = "step",
    elapsed: str = "elapsed_s",
) -> DataFrame:
    """(by, stop_step, reason, stop_at): the first check at which a run is to stop.

    Only every ``interval``-th step is checked. The time limit goes before the loss rule and
    grants extra steps.
    """
    lowest = running_min_loss(steps, by, step)
    late = F.lit(False) if time_limit is None else F.col(elapsed) >= time_limit
    rising = (F.col(step) > warmup) & (F.col("loss") > factor * F.col("min_loss"))
    reason = F.when(late, "time limit reached").when(rising, "early stopping from loss increase")
    hits = lowest.where(F.col(step) % interval == 0).withColumn("reason", reason).where(F.col("reason").isNotNull())
    first = hits.groupBy(*by).agg(F.min(step).alias("stop_step"), F.min_by("reason", step).alias("reason"))
    extra = F.when(F.col("reason") == "time limit reached", extra_steps).otherwise(0)
    return first.withColumn("stop_at", F.col("stop_step") + extra)


def masked_instances(instances: DataFrame, keys: Sequence[str] = ("step", "rank")) -> DataFrame:
    """Masked instances per step and rank."""
    return instances.groupBy(*keys).agg(F.count(F.when(~F.col("instance_mask"), 1)).alias("masked_instances"))


def label_normalised_loss(instances: DataFrame, by_labels: bool = True) -> DataFrame:
    """(step, loss): summed loss over labelled tokens, or over all, per rank; then mean of ranks.

    Labels are counted before the shift. Ranks weigh the same whatever their tokens.
    """
    items = "n_labels" if by_labels else "n_tokens"
    per_rank = instances.groupBy("step", "rank").agg(F.try_divide(F.sum("loss_sum"), F.sum(items)).alias("loss"))
    return rank_reduce(per_rank, "loss")


def rank_reduce(per_rank: DataFrame, value: str, step: str = "step") -> DataFrame:
    """Sum over ranks divided by their number."""
    return per_rank.groupBy(step).agg((F.sum(value) / F.count(F.lit(1))).alias(value))


def metric_window_mean(
    metrics: DataFrame, accumulation: int, logging_steps: int, world: int, micro: str = "micro_step"
) -> DataFrame:
    """(window, name, value): metrics of a logging window, averaged over ranks and micro-steps.

    A window that never fills up is never logged.
    """
    per_window = accumulation * logging_steps
    grouped = metrics.groupBy(F.floor(F.col(micro) / per_window).cast("bigint").alias("window"), "name").agg(
        F.sum("value").alias("__sum"), F.count(F.lit(1)).alias("__n")
    )
    full = grouped.where(F.col("__n") == per_window * world)
    return full.select(
        "window",
        ((F.col("window") + 1) * logging_steps).alias("training_step"),
        "name",
        (F.col("__sum") / world / per_window).alias("value"),
    )


AVERAGED_LOSSES = ("simpo", "dpo_norm")  # fixed value: loss types that average log-probabilities


def pair_logp(tokens: DataFrame, loss_type: str = "dpo", keys: Sequence[str] = ("pair_id", "side")) -> DataFrame:
    """Sum, or for some loss types mean, of response token log-probabilities per side."""
    value = F.avg("logprob") if loss_type in AVERAGED_LOSSES else F.sum("logprob")
    return tokens.groupBy(*keys).agg(value.alias("logp"))


def preference_rewards(pairs: DataFrame, beta: float, batch: str = "batch_id") -> DataFrame:
    """Rewards per batch: chosen, rejected, average, margin, accuracy.

    The accuracy compares batch means, so it is 0 or 1; ``pair_accuracy`` compares pairs.
    """
    chosen = beta * (F.col("policy_chosen") - F.col("ref_chosen"))
    rejected = beta * (F.col("policy_rejected") - F.col("ref_rejected"))
    means = pairs.groupBy(batch).agg(
        F.avg(chosen).alias("chosen"),
        F.avg(rejected).alias("rejected"),
        F.avg((chosen > rejected).cast("double")).alias("pair_accuracy"),
        F.avg("policy_chosen").alias("logps_chosen"),
        F.avg("policy_rejected").alias("logps_rejected"),
    )
    return (
        means.withColumn("average", (F.col("chosen") + F.col("rejected")) / 2)
        .withColumn("margin", F.col("chosen") - F.col("rejected"))
        .withColumn("accuracy", (F.col("chosen") > F.col("rejected")).cast("double"))
    )
