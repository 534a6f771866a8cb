"""Seeded order, equal shares for ranks and workers, interleaving, batches, counters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import arrays as A
from millrace.functions.hashing import seeded_md5
from millrace.operators.prefix import DENSE_KEY, hashed_position, running_offset


def seeded_order(instances: DataFrame, seed: int, key: str = "instance_id", epoch: int = 0) -> DataFrame:
    """(position, key): a permutation from seed plus epoch, the same on every run."""
    return hashed_position(instances.select(key), seeded_md5(seed + epoch, key), ties=[key])


def epoch_orders(instances: DataFrame, seed: int, epochs: int, key: str = "instance_id") -> DataFrame:
    """(epoch, position, key) for each epoch; every epoch uses the next seed."""
    every = instances.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    digest = F.md5(F.concat_ws(":", (F.col("epoch") + seed).cast("string"), F.col(key).cast("string")))
    placed = hashed_position(every, digest, ties=[key], by=["epoch"])
    return placed.withColumn("epoch", F.col("epoch").cast("bigint"))


def even_world(order: DataFrame, world: int, drop_last: bool, size: Column | None = None) -> DataFrame:
    """Make the order a multiple of ``world``: cut it, or repeat it from its start.

    ``size`` is the number of instances; given, the order is not computed to be counted.
    """
    n = order.agg(F.count(F.lit(1))).scalar() if size is None else size
    if drop_last:
        return order.where(F.col("position") < n - n % world)
    total = F.ceil(n / world) * world
    # how many laps a position takes part in: the first, and every later one that reaches it
    laps = F.floor((total - F.col("position") - 1) / n)
    return (
        order.withColumn("__lap", F.explode(F.sequence(F.lit(0).cast("bigint"), laps)))
        .withColumn("position", (F.col("position") + F.col("__lap") * n).cast("bigint"))
        .drop("__lap")
    )


@dataclass(frozen=True)
class RunState:
    """Where a run stopped, as its checkpoint says."""

    examples_seen: int
    epoch: int = 0
    checkpoint_epoch: int = 0
    tokens_seen: int = 0
    restore: bool = True
    fast_forward_batches: int = 0
    global_batch: int = 0

    def resume(self) -> tuple[int, int]:
        """(start index, tokens seen). Fast-forwarding moves the index, not the tokens."""
        seen, tokens = self.examples_seen, self.tokens_seen
        if not self.restore:
            seen, tokens = 0, 0
        elif self.checkpoint_epoch != self.epoch:
            seen = 0
        return seen + self.fast_forward_batches * self.global_batch, tokens


def slice_order(order: DataFrame, world: int, max_examples: int | None = None, start: int = 0) -> DataFrame:
    """The first ``max_examples`` positions, then without the first ``start``."""
    if max_examples is not None:
        if max_examples % world:
            raise ValueError("max_examples must divide by the world size")
        order = order.where(F.col("position") < max_examples)
    return order.where(F.col("position") >= start)


def rank_stripe(order: DataFrame, world: int, start: int = 0) -> DataFrame:
    """rank and local position: from ``start`` on, rank r takes every ``world``-th."""
    at = F.col("position") - F.lit(start)
    return order.withColumn("rank", F.pmod(at, F.lit(world)).cast("bigint")).withColumn(
        "local", F.floor(at / world).cast("bigint")
    )


def worker_stripe(striped: DataFrame, world: int, start: int, batch: int, workers: int, total: int | Column) -> DataFrame:
    """worker and its own order: whole batches in turn, left-overs one by one at the end.

    ``total`` is the end of the sliced order: one more than its last position.
    """
    n = (F.lit(total) if isinstance(total, int) else total) - F.lit(start)
    per_rank = F.floor((n - F.col("rank") + world - 1) / world)
    whole = F.floor(per_rank / batch) * batch
    local = F.col("local")
    left = local >= whole
    worker = F.when(left, (local - whole) % workers).otherwise(F.floor(local / batch) % workers)
    batches_before = F.floor(local / batch / workers) * batch + local % batch
    own_whole = F.floor((whole / batch - worker + workers - 1) / workers) * batch
    seq = F.when(left, own_whole + F.floor((local - whole) / workers)).otherwise(batches_before)
    return striped.withColumn("worker", worker.cast("bigint")).withColumn("worker_seq", seq.cast("bigint"))


def interleave_round_robin(
    streams: DataFrame, stream: str, key: str, out: str = "position"
) -> DataFrame:
    """Positions of taking one item of each stream in turn, skipping the exhausted.

    ``stream`` orders the streams and ``key`` the items of one, both integers or, for streams, texts;
    a null stream is the first. An item comes after all items of lower turn and those of its own
    turn in earlier streams.
    """
    turned = running_offset(streams, key, by=[stream], out="__turn")
    # streams by number; a name's first bytes put it into its range
    head = F.rpad(F.hex(F.substring(F.encode(F.col(stream).cast("string"), "utf-8"), 1, 7)), 14, "0")
    number = F.col(stream).cast("bigint") if dict(streams.dtypes)[stream] in ("int", "bigint") else F.conv(head, 16, 10).cast("bigint")
    names = streams.select(stream).distinct().withColumn("__head", number)
    ranks = running_offset(names, "__head", ties=[stream], out="__rank").select(F.col(stream).alias("__name"), "__rank")
    ranked = turned.join(ranks, F.col(stream).eqNullSafe(F.col("__name"))).drop("__name")
    # items of one turn by stream, in ranges of streams, after all items of the turns before; ranks and
    # turns are dense, so one level of ranges holds 2**32 of them
    within = running_offset(ranked, "__rank", by=["__turn"], out="__in", shifts=DENSE_KEY)
    turns = ranked.groupBy("__turn").agg(F.count(F.lit(1)).alias("__n"))
    before = running_offset(turns, "__turn", F.col("__n"), out="__before", shifts=DENSE_KEY).select("__turn", "__before")
    placed = within.join(before, "__turn").withColumn(out, F.col("__before") + F.col("__in"))
    return placed.select(*streams.columns, out)


def collate_batches(
    rows: DataFrame,
    batch: Sequence[str],
    order: str,
    pad_id: int,
    side: str = "right",
    index: str | None = "instance_id",
) -> DataFrame:
    """One row per batch, each batch padded to its own longest row.

    Optional columns (attention_mask, label_mask, instance_mask, metadata) are carried only
    when present. A batch is a device batch, so the collected lists are bounded by its size.
    """
    present = rows.columns
    fills = {"input_ids": F.lit(pad_id), "attention_mask": F.lit(0), "label_mask": F.lit(False)}
    padded = [c for c in fills if c in present]
    carried = [c for c in ([index] if index else []) + ["instance_mask", "metadata"] if c in present]
    grouped = rows.groupBy(*batch).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col(order).alias("__o"), *padded, *carried)),
            lambda a, b: (a["__o"] > b["__o"]).cast("int") - (a["__o"] < b["__o"]).cast("int"),
        ).alias("rows"),
        F.max(F.size("input_ids")).alias("max_len"),
    )
    out = [F.col(b) for b in batch]
    for name in padded:
        fill = fills[name]
        out.append(F.transform(F.col("rows")[name], lambda v: A.pad(v, F.col("max_len"), fill, side)).alias(name))
    out += [F.col("rows")[name].alias(name) for name in carried]
    return grouped.select(*out, F.col("max_len").cast("bigint").alias("max_len"))


def microbatches(rows: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """Number of the micro-batch within its batch; the last may be short."""
    return rows.withColumn("micro", F.floor(F.col(pos) / size).cast("bigint"))


def cap_batches(
    batches: DataFrame, number: str, default: int, override: int | None = None
) -> DataFrame:
    """Only the first k batches; an override wins over the default, non-positive means all."""
    k = default if override is None else override
    return batches.where(F.col(number) < k) if k > 0 else batches


def eval_batch_size(wanted: int, n_instances: int, world: int, drop_last: bool) -> int:
    """The batch size, made small enough for the data when the last batch is dropped."""
    if not drop_last:
        return wanted
    size = min(wanted, n_instances // world)
    if size <= 0:
        raise ValueError("the dataset is too small")
    return size


def progress_counters(steps: DataFrame, batch: int, seq_len: int, epoch: str = "epoch", step: str = "step") -> DataFrame:
    """Per step: examples so far in its epoch, and tokens so far in the run.

    Counts come from dense positions, so a long run is not one sorted partition.
    """
    whole = running_offset(steps, step, out="__all")
    per_epoch = running_offset(whole, step, by=[epoch], out="__here")
    return (
        per_epoch.withColumn("global_step", F.col("__all") + 1)
        .withColumn("examples_this_epoch", (F.col("__here") + 1) * batch)
        .withColumn("tokens", (F.col("__all") + 1) * (batch * seq_len))
        .drop("__all", "__here")
    )


def upsample(rows: DataFrame, keys: Sequence[str], times: int, seed: int) -> DataFrame:
    """Every row ``times`` times, then in seeded order; ids repeat."""
    copies = rows.withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(times - 1).cast("bigint"))))
    return hashed_position(copies, seeded_md5(seed, *keys, "copy_no"), ties=[*keys, "copy_no"])


def limit_samples(rows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows in key order; all of them when there are fewer."""
    return rows.orderBy(*keys).limit(limit)


def preview_sample(rows: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """A few distinct random rows to look at."""
    return rows.withColumn("__h", seeded_md5(seed, *keys)).orderBy("__h", *keys).limit(n).drop("__h")


def prompt_batches(prompts: DataFrame, key: str, size: int = 1000) -> DataFrame:
    """Number of each prompt's batch: consecutive prompts, ``size`` each, the last short."""
    placed = running_offset(prompts, key, out="__place")
    return placed.withColumn("batch_no", F.floor(F.col("__place") / size).cast("bigint")).drop("__place")
