"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def free_names(taken, *wanted: str) -> list[str]:
    """The wanted names, each with underscores added until no column has it."""
    out = []
    for name in wanted:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def row_keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """128 bits that rows share only if id and text are equal; neither is null."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), doc_id, text)


def bounded(df: DataFrame, rows: int, weight: Column | None = None) -> DataFrame:
    """``df``, marked for broadcast if its rows (or summed weights) are counted to be few enough."""
    size = df.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(df) if size <= rows else df
