"""The run metrics of an endless feed: throughput, running minimum and early stop per rank.

State per rank is the recorded batches of one window, the smallest loss, a flag and the last step,
whatever the length of the run. Within a micro-batch steps are sorted here; a step that comes in
a later micro-batch than a higher one of its rank stops the stream, as its window is gone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = (
    "rank bigint, step bigint, window_tokens bigint, window_batches bigint, tokens_per_second double, "
    "batches_per_second double, min_loss double, stop boolean"
)
STATE = "starts array<double>, tokens array<bigint>, min_loss double, seen boolean, stopped boolean, last bigint"


# Rows that are worked on at once; what is held of the other rows of a micro-batch is six plain columns.
SLICE = 1 << 16
COLUMNS = {"step": None, "start_s": None, "check_s": None, "tokens": None, "loss": None, "reset": bool}


class Held(NamedTuple):
    """What a rank keeps between rows; the fields are those of ``STATE``."""

    starts: list[float]
    tokens: list[int]
    min_loss: float
    seen: bool
    stopped: bool
    last: int | None


def _columns(frames: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
    """The columns of all frames, without the frames."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name in COLUMNS}
    for frame in frames:
        for name, kind in COLUMNS.items():
            parts[name].append(frame[name].to_numpy(kind, copy=True))
    return {name: np.concatenate(parts.pop(name)) if parts[name] else np.zeros(0) for name in COLUMNS}


def _advance(rows: dict[str, np.ndarray], held: Held, window: int, factor: float, warmup: int, interval: int) -> tuple[dict, Held]:
    """Metrics of some rows in order of their steps, and what is held after them."""
    minima = np.minimum(np.minimum.accumulate(rows["loss"]), held.min_loss)
    n = len(rows["step"])
    resets = rows["reset"]
    # a batch is in the window of a later one if no reset lies between and it is recent
    recorded = np.ones(n, bool)
    recorded[0] = held.seen
    all_starts = np.concatenate([np.array(held.starts, float), rows["start_s"][recorded]])
    all_tokens = np.concatenate([np.array(held.tokens, np.int64), rows["tokens"][recorded]])
    index = len(held.starts) + np.cumsum(recorded) - 1  # place of each row's own record, -1 when it has none
    ends = np.where(resets, index + 1, 0)
    floor = np.concatenate([[0], np.maximum.accumulate(ends)[:-1]])  # first place after the last reset
    low = np.maximum(floor, index - window + 1)
    sums = np.concatenate([[0], np.cumsum(all_tokens)])
    has = index >= low
    safe_low, safe_high = np.where(has, low, 0), np.where(has, index + 1, 0)
    total = sums[safe_high] - sums[safe_low]
    count = safe_high - safe_low
    first = all_starts[np.minimum(safe_low, max(len(all_starts) - 1, 0))] if len(all_starts) else np.zeros(n)
    seconds = rows["check_s"] - first
    rate = np.where(has & (seconds != 0), 1.0, np.nan) / np.where(seconds == 0, 1.0, seconds)
    step = rows["step"]
    hit = (step > warmup) & (step % interval == 0) & (rows["loss"] > factor * minima)
    fires = hit & (np.cumsum(hit) == 1) & (not held.stopped)
    keep_from = max(index[-1] + 1 - window, index[-1] + 1 if resets[-1] else max(int(floor[-1]), 0))
    after = Held(
        [float(x) for x in all_starts[keep_from:]],
        [int(x) for x in all_tokens[keep_from:]],
        float(minima[-1]),
        True,
        bool(held.stopped or hit.any()),
        int(step[-1]),
    )
    return {
        "step": step,
        "window_tokens": pd.array(np.where(has, total, 0), dtype="Int64").copy(),
        "window_batches": pd.array(count, dtype="Int64"),
        "tokens_per_second": total * rate,
        "batches_per_second": count * rate,
        "min_loss": minima,
        "stop": fires,
    }, after


def metrics_stream(
    steps: DataFrame, window: int, factor: float, warmup: int, interval: int
) -> DataFrame:
    """Streaming counterpart of the batch operators; the input has rank, step, start_s,
    check_s, tokens, loss and reset."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Held(*state.get) if state.exists else Held([], [], float("inf"), False, False, None)
        rows = _columns(frames)
        order = np.argsort(rows["step"])
        if not len(order):
            return
        if held.last is not None and rows["step"][order[0]] <= held.last:
            raise ValueError(f"step {rows['step'][order[0]]} of rank {key[0]} came after step {held.last}")
        for at in range(0, len(order), SLICE):
            part = {name: values[order[at : at + SLICE]] for name, values in rows.items()}
            out, held = _advance(part, held, window, factor, warmup, interval)
            yield pd.DataFrame({"rank": key[0], **out})
        state.update(tuple(held))

    return steps.groupBy("rank").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_table(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain what is available into Parquet and read it; nothing passes through the driver."""
    running = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
