"""Reading documents, named corpora, token chunks and preference pairs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.sources import manifests, zstd_lines

DOCUMENT_SCHEMA = "id string, text string, source string"
MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def read_documents(
    spark: SparkSession,
    globs: Sequence[str],
    schema: str = DOCUMENT_SCHEMA,
    source: str | None = None,
    source_pattern: str | None = None,
) -> DataFrame:
    """JSON lines from many globs in one scan; compression follows the file ending, zstd (``.zst``) included.

    ``source`` names all rows; ``source_pattern`` takes its first group from the file path, where
    the escapes of a URI and then those of a partition folder are undone. Without either
    the column of the record is kept. The schema is given, never inferred.
    """
    packed = [g for g in globs if g.endswith(zstd_lines.ENDING)]
    plain = [g for g in globs if g not in packed]
    parts = []
    if plain or not packed:
        parts.append(_sourced(spark.read.schema(schema).json(plain), _unescaped(F.col("_metadata.file_path")), source, source_pattern))
    if packed:
        docs = zstd_lines.read_json(spark, packed, schema)
        parts.append(_sourced(docs, F.col("__file"), source, source_pattern).drop("__file"))
    return reduce(DataFrame.unionByName, parts)


def _sourced(docs: DataFrame, file: Column, source: str | None, source_pattern: str | None) -> DataFrame:
    if source is not None:
        return docs.withColumn("source", F.lit(source))
    if source_pattern is not None:
        return docs.withColumn("source", _unescaped(F.regexp_extract(file, source_pattern, 1)))
    return docs


def _unescaped(text: Column) -> Column:
    """``%XX`` as the byte it stands for; a plus sign is one."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


@dataclass(frozen=True)
class Corpus:
    """Where a named corpus lies and what its configurations and splits select."""

    path: str
    configs: Mapping[str, Column] = field(default_factory=dict)
    splits: Mapping[str, Column] = field(default_factory=dict)
    convert: Callable[[DataFrame], DataFrame] | None = None

    def split_name(self) -> Column:
        """The first split that a row belongs to, so that one scan serves all of them."""
        name = F.lit(None).cast("string")
        for split, holds in reversed(self.splits.items()):
            name = F.when(holds, F.lit(split)).otherwise(name)
        return name


def load_corpus(
    spark: SparkSession,
    corpora: Mapping[str, Corpus],
    name: str,
    config: str | None = None,
    split: str | None = None,
) -> DataFrame:
    """A corpus by name, configuration and split; anything unknown is an error."""
    if name not in corpora:
        raise NotImplementedError(f"the dataset {name} is not supported")
    corpus = corpora[name]
    rows = spark.read.parquet(corpus.path)
    for chosen, known in ((config, corpus.configs), (split, corpus.splits)):
        if chosen is None:
            continue
        if chosen not in known:
            raise ValueError(f"{name} has no {chosen!r}")
        rows = rows.where(known[chosen])
    return corpus.convert(rows) if corpus.convert else rows


def stored_position(spark: SparkSession, path: str, columns: Sequence[str], out: str = "position") -> DataFrame:
    """Rows of a Parquet table with their dense place in stored order: by file, then by row.

    A row knows its place in its file, so only file sizes have to be added up. The rows
    themselves are not shuffled, however wide they are.
    """
    from millrace.session import stage

    rows = spark.read.parquet(path).select(
        *columns, F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row")
    )
    sizes = rows.groupBy("__path").agg((F.max("__row") + 1).alias("n_rows"))
    # written first, so that its true size decides how it is joined
    files = stage(manifests.chunk_offsets(sizes, "n_rows", "__path").select("__path", "start"), "files")
    placed = rows.join(files, "__path")
    return placed.select(*columns, (F.col("start") + F.col("__row")).alias(out))


def fold_bounds(df: DataFrame, key: str, folds: int = 10) -> list[int | None]:
    """The first key of folds 1, 2, ...; None where no row is left.

    Fold k of n rows holds the places [round(n*k/folds), round(n*(k+1)/folds)) in key order,
    rounded half to even. Only keys are placed, and only the bounds come back.
    """
    from millrace.operators.prefix import dense_position

    keys = df.select(key)
    n = keys.count()
    edges = [round(n * (100 * k // folds) / 100) for k in range(1, folds)]
    placed = dense_position(keys, key, out="__place")
    row = placed.agg(*[F.min(F.when(F.col("__place") >= e, F.col(key))) for e in edges]).first()
    return list(row)


def with_folds(df: DataFrame, key: str, folds: int = 10) -> DataFrame:
    """Every row with its fold number; the folds are disjoint and complete.

    A fold is a range of the key, so rows are compared with the bounds and stay where they are.
    """
    passed = [(F.col(key) >= b).cast("bigint") for b in fold_bounds(df, key, folds) if b is not None]
    return df.withColumn("fold", sum(passed, F.lit(0)).cast("bigint"))


def percent_fold(df: DataFrame, key: str, fold: int, folds: int = 10) -> DataFrame:
    """Rows of one fold of the order of a unique integer key: a range the scan can skip to."""
    bounds = [None, *fold_bounds(df, key, folds), None]
    low, high = bounds[fold], bounds[fold + 1]
    if fold > 0:
        df = df.where(F.col(key) >= low) if low is not None else df.limit(0)
    return df.where(F.col(key) < high) if high is not None else df


def read_token_chunks(
    spark: SparkSession, path: str, shard: str | None = None, instance: int | None = None
) -> DataFrame:
    """Token chunks of a written shard table.

    ``shard`` prunes to one directory and ``instance`` to the row groups that hold the chunk,
    so a single chunk is read without the rest.
    """
    chunks = spark.read.parquet(path)
    if shard is not None:
        chunks = chunks.where(F.col("shard_id") == shard)
    if instance is not None:
        chunks = chunks.where(F.col("instance_id") == instance)
    return chunks


def read_preferences(
    spark: SparkSession,
    name: str | None = None,
    mixer: Mapping[str, float] | None = None,
    mixer_list: Sequence[str | float] | None = None,
    file: str | None = None,
    load: Callable[[str], DataFrame] | None = None,
    key: str = "pair_id",
    seed: int = 42,
) -> DataFrame:
    """Preference pairs from exactly one of a name, a mixture, a flat mixture list or a file."""
    given = [x for x in (name, mixer, mixer_list, file) if x is not None]
    if not given:
        raise ValueError("need a dataset name, a mixture or a file")
    if len(given) > 1:
        raise ValueError("only one way of choosing the dataset may be given")
    if file is not None:
        if file.rstrip("/").rsplit(".", 1)[-1] not in ("json", "jsonl"):
            raise ValueError("the file must be json or jsonl")
        schema = f"{key} bigint, chosen {MESSAGES_TYPE}, rejected {MESSAGES_TYPE}"
        rows = spark.read.schema(schema).json(file)
    else:
        if load is None:
            raise ValueError("a named dataset needs a loader")
        if name is not None:
            rows = load(name)
        else:
            from millrace.operators.mixture import mix_datasets, parse_mixer_list

            amounts = mixer if mixer is not None else parse_mixer_list(mixer_list)
            rows = mix_datasets({n: load(n) for n in amounts}, amounts, key, seed)
    names = set(rows.columns)
    if {"prompt", "completion"} <= names:
        raise ValueError("prompt and completion records are not preference pairs")
    if not {"chosen", "rejected"} <= names:
        raise ValueError("chosen and rejected columns are needed")
    return rows.select(*([key] if key in names else []), "chosen", "rejected")
