"""Periodic stretches of words: where a text repeats itself at once, again and again.

A run of period q and at least ``4 * q`` words holds four places in a row of the grid of multiples of
q, and the words there are equal; such places are the candidates. Grids of all periods together are a
harmonic sum, n log n places. Each candidate is extended both ways by the common extensions of
a run-length grammar. The texts of a batch are one sequence, a number of its own between any two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.frames import free_names
from millrace.llm.recompression import Grammar
from millrace.llm.words import slices

LEAST_WORDS = 6
REPEATS = 4
# Candidates that are extended together.
TOGETHER = 1 << 17


def with_runs(docs: DataFrame, out: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of each text and the text without their repetitions.

    Words are runs outside blank and x09-x0D, numbered from 0. A run is a stretch of smallest period q and
    at least max(6, 4 * q) words that no neighbouring word extends; ``out`` lists (start, length,
    period) by start and period. ``collapsed`` has the words, joined by one blank, without those
    that a run contains after its first q. A null or empty text has no runs and an empty
    ``collapsed``. Rows are kept as they are, also repeated ones and those with null ids; all other
    columns stay, and a name already taken gets an underscore. Memory follows a few megabytes
    of texts or the longest text.
    """
    out, collapsed = free_names(docs.columns, out, collapsed)
    kind = docs.select("text").schema["text"].dataType.simpleString()
    if kind != "string":
        raise ValueError(f"text is {kind}, not string")
    names = docs.columns
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema]
    schema = ", ".join([*fields, f"{out} array<struct<start:bigint,length:bigint,period:bigint>>", f"{collapsed} string"])
    return docs.mapInArrow(lambda batches: _with_runs(batches, names.index("text"), [*names, out, collapsed]), schema)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _with_runs(batches: Iterator[pa.RecordBatch], text: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, raw, offsets in slices(batch.column(text)):
            texts = [raw[a:b].tobytes().split() for a, b in zip(offsets[:-1], offsets[1:])]
            runs = runs_of(texts)
            kept = [b" ".join(collapse(words, own) if own else words) for words, own in zip(texts, runs)]
            lists = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
            part = batch.slice(first, len(texts))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(lists, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string())], names=names
            )


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start and period."""
    numbers = {word: i for i, word in enumerate(dict.fromkeys(word for words in texts for word in words))}
    lengths = np.array([len(words) for words in texts], np.int64)
    begins = np.cumsum(np.append(0, lengths + 1))[:-1] + 1  # one border before each text, one after the last
    sequence = np.empty(int(lengths.sum()) + len(texts) + 1, np.int64)
    borders = np.append(begins - 1, len(sequence) - 1)
    inner = np.ones(len(sequence), bool)
    inner[borders] = False
    sequence[inner] = np.fromiter((numbers[word] for words in texts for word in words), np.int64, int(lengths.sum()))
    sequence[borders] = len(numbers) + np.arange(len(borders))
    starts, ends, periods = find_runs(sequence, int(lengths.max()) if len(lengths) else 0)
    order = np.lexsort((periods, starts))
    owner = np.searchsorted(begins, starts[order], "right") - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for text, run in zip(owner.tolist(), order.tolist()):
        out[text].append((int(starts[run] - begins[text]), int(ends[run] - starts[run]), int(periods[run])))
    return out


def candidates(sequence: np.ndarray, period: int) -> np.ndarray:
    """Grid places from which four grid places in a row are equal."""
    grid = sequence[::period]
    same = grid[1:] == grid[:-1]
    chain = same[: len(same) - REPEATS + 2].copy()
    for shift in range(1, REPEATS - 1):
        chain &= same[shift : len(same) - REPEATS + 2 + shift]
    return np.flatnonzero(chain) * period


def find_runs(sequence: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, smallest periods) of the runs of a sequence whose borders are unique numbers.

    Periods go up in octaves. A multiple of a period is in a later octave than the period itself, so its
    places inside the run that is known by then need no extension: they would give that run again.
    """
    grammar: Grammar | None = None
    known = [np.zeros(0, np.int64) for _ in range(3)]
    inside = np.full(len(sequence), -1, np.int64)  # a run that contains the place
    low = 1
    while low * REPEATS <= longest:
        places, steps, held = [], [], 0
        found = []
        for period in range(low, min(2 * low, longest // REPEATS + 1)):
            at = candidates(sequence, period)
            if len(at) and len(known[0]):
                run = inside[at]
                start, end, smaller = (x[run] for x in known)
                again = (run >= 0) & (period % np.maximum(smaller, 1) == 0) & (at + period < end) & (end - start >= period + smaller)
                at = at[~again]
            if len(at):
                places.append(at)
                steps.append(np.full(len(at), period))
                held += len(at)
            if held >= TOGETHER or (held and period + 1 == min(2 * low, longest // REPEATS + 1)):
                grammar = grammar or Grammar(sequence)
                found.append(extended(grammar, np.concatenate(places), np.concatenate(steps)))
                places, steps, held = [], [], 0
        if held:
            grammar = grammar or Grammar(sequence)
            found.append(extended(grammar, np.concatenate(places), np.concatenate(steps)))
        if found:
            known = smallest_periods(*(np.concatenate(x) for x in zip(known, *found)))
            for run in np.argsort(known[1] - known[0], kind="stable").tolist():
                inside[known[0][run] : known[1][run]] = run
        low *= 2
    return tuple(known)


def extended(grammar: Grammar, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches around grid places that repeat with the period and are long enough."""
    start = place - grammar.common_behind(place, place + period)
    end = place + period + grammar.common_ahead(place, place + period)
    good = end - start >= np.maximum(LEAST_WORDS, REPEATS * period)
    return smallest_periods(start[good], end[good], period[good])


def smallest_periods(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> list[np.ndarray]:
    """Each stretch once, with the smallest of its periods."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, bool)
    return [start[first], end[first], period[first]]
