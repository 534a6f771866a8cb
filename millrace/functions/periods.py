"""Runs of a repeated short period in an id array, as Arrow functions.

A run of period p is a stretch where x[i] = x[i-p] over at least 2p positions. Finding it is
one shifted comparison per period over a whole batch, which numpy does at memory speed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

MASK_VALUE = -1  # fixed value: may not occur in the ids

RUN_TYPE = "array<struct<start:bigint,end:bigint,period:bigint,times:bigint>>"


def _batch_runs(batch: pa.Array, min_period: int, max_period: int):
    """(row, start, end, period) of every run in a batch of lists."""
    starts = batch.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    flat = batch.flatten().to_numpy(zero_copy_only=False)
    if (flat == MASK_VALUE).any():
        raise ValueError("the mask value is in the array")
    lengths = np.diff(starts)
    row_of = np.repeat(np.arange(len(lengths)), lengths)
    found = []
    for period in range(min_period, max_period + 1):
        if len(flat) <= period:
            break
        same = (flat[period:] == flat[:-period]) & (row_of[period:] == row_of[:-period])
        edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
        first, stop = edge[::2] + period, edge[1::2] + period
        keep = (stop - first) >= 2 * period
        first, stop = first[keep], stop[keep]
        rows = row_of[first]
        found.append((rows, first - period - starts[rows], stop - starts[rows], np.full(len(rows), period)))
    if not found:
        empty = np.zeros(0, np.int64)
        return starts, empty, empty, empty, empty
    return (starts, *(np.concatenate(part) for part in zip(*found)))


def periodic_sequences(ids: Column, min_period: int = 1, max_period: int = 13) -> Column:
    """All runs repeating at least three times: start, end (exclusive), period, times."""

    @F.arrow_udf(RUN_TYPE)
    def find(batch: pa.Array) -> pa.Array:
        starts, rows, first, stop, period = _batch_runs(batch, min_period, max_period)
        order = np.lexsort((first, period, rows))
        rows, first, stop, period = rows[order], first[order], stop[order], period[order]
        per_row = np.bincount(rows, minlength=len(starts) - 1) if len(starts) > 1 else np.zeros(0, np.int64)
        offsets = np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)
        runs = pa.StructArray.from_arrays(
            [pa.array(x.astype(np.int64)) for x in (first, stop, period, (stop - first) // np.maximum(period, 1))],
            names=["start", "end", "period", "times"],
        )
        return pa.ListArray.from_arrays(pa.array(offsets), runs)

    return find(F.coalesce(ids, F.array().cast("array<int>")))


def longest_repetition(ids: Column, min_period: int = 1, max_period: int = 13) -> Column:
    """Most repetitions of any run; 0 when there is none."""

    @F.arrow_udf("bigint")
    def most(batch: pa.Array) -> pa.Array:
        starts, rows, first, stop, period = _batch_runs(batch, min_period, max_period)
        out = np.zeros(len(starts) - 1, np.int64)
        np.maximum.at(out, rows, (stop - first) // np.maximum(period, 1))
        return pa.array(out)

    return most(F.coalesce(ids, F.array().cast("array<int>")))
