"""Rows that every operator must take: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

LONG = "".join(f"word{i % 977} runs on, line {i}\n" for i in range(20_000))
PROSE = " ".join(f"alpha{i} beta{i * 7 % 31} gamma{i % 13}" for i in range(60))

ROWS = [
    (1, PROSE, "en", "a", 5), (2, PROSE, "en", "b", 5), (3, None, "en", "a", None), (4, "", None, None, 0), (5, "   \n \n", "de", "c", 6),
    (6, "one", "de", "c", 3), (7, LONG, "fr", "a", 1), (8, "Überß naïve 你好 😀 end", "fr", "b", 1), (8, "Überß naïve 你好 😀 end", "fr", "b", 1),
    (None, "nobody's text", "es", "a", 2), (9, PROSE + " omega", "en", "c", 5), (10, "aaa " * 500, "en", "d", 9),
]
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside or return.
CLASH = ("k", "k1", "k2", "d1", "place", "places", "part", "class", "score", "spans", "first_ids", "chunks", "input_ids", "h1", "block", "row", "n_removed")


def documents(spark, rows=None, clash=False):
    df = spark.createDataFrame(ROWS if rows is None else rows, KIND)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASH})
    return df


def empty(spark):
    return spark.createDataFrame([], KIND)
