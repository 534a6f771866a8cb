"""Sampling per source, choosing shards, mixing datasets and reporting mixtures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions.hashing import seeded_md5, seeded_unit
from millrace.operators.prefix import hashed_position


def sample_by_source(
    df: DataFrame, fractions: Mapping[str, float], key: str, seed: int, source: str = "source"
) -> DataFrame:
    """Keep each row with its source's fraction; a source without one is kept whole.

    The draw is the seeded hash of the key, so it needs no shuffle and survives retries.
    """
    table = df.sparkSession.createDataFrame(list(fractions.items()), f"`{source}` string, __fraction double")
    joined = df.join(table, source, "left")  # its known size decides how
    return joined.where(
        seeded_unit(seed, key) < F.coalesce(F.col("__fraction"), F.lit(1.0))
    ).select(*df.columns)


def select_shards(df: DataFrame, manifest: DataFrame, on: Sequence[str] = ("source", "shard")) -> DataFrame:
    """Whole-shard selection: rows whose shard is listed."""
    return df.join(manifest.select(*on), list(on), "left_semi")


def parse_mixer_list(flat: Sequence[str | float]) -> dict[str, float]:
    """[name, amount, name, amount, ...] to a mapping."""
    if len(flat) % 2:
        raise ValueError("a mixer list alternates names and amounts")
    return {str(flat[i]): float(flat[i + 1]) for i in range(0, len(flat), 2)}


def mix_datasets(
    parts: Mapping[str, DataFrame], amounts: Mapping[str, float], key: str, seed: int, columns: Sequence[str] | None = None
) -> DataFrame:
    """Concatenate a sample of every part.

    An amount up to 1 is a fraction; above 1 it is a number of rows, the first ones in
    seeded order. Only the keys are put in order, to find the last one that is taken; the
    rows are then compared with it where they are.
    """
    chosen = []
    for name, amount in amounts.items():
        part = parts[name]
        if amount <= 1:
            part = part.where(seeded_unit(seed, key) < F.lit(float(amount)))
        else:
            digest = seeded_md5(seed, key)
            placed = hashed_position(part.select(key), digest, ties=[key], out="__place")
            taken = placed.where(F.col("__place") < int(amount))
            last = taken.agg(F.max(F.struct(digest.alias("h"), F.col(key).alias("k")))).scalar()
            part = part.where(F.struct(digest.alias("h"), F.col(key).alias("k")) <= last)
        chosen.append(part.select(*columns) if columns else part)
    return reduce(lambda a, b: a.unionByName(b), chosen)


def mixture_report(df: DataFrame, tokens: Column, shard: str = "shard", source: str = "source") -> DataFrame:
    """Files, documents, tokens and shares per source.

    Totals are taken over the per-source rows, of which there are as many as sources.
    """
    files = F.countDistinct(shard).alias("files")
    per = df.groupBy(source).agg(
        files, F.count(F.lit(1)).alias("documents"), F.sum(tokens).cast("bigint").alias("tokens")
    )
    every = Window.partitionBy()
    return per.withColumn(
        "document_share", F.round(F.col("documents") / F.sum("documents").over(every), 9)
    ).withColumn("token_share", F.round(F.col("tokens") / F.sum("tokens").over(every), 9))


def union_sources(parts: Mapping[str, DataFrame], label: str = "label") -> DataFrame:
    """Concatenate in sorted label order, keeping where each row came from."""
    tagged = [parts[name].withColumn(label, F.lit(name)) for name in sorted(parts)]
    return reduce(lambda a, b: a.unionByName(b), tagged)
