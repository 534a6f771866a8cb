"""Writing JSON lines, token shards, data orders, index traces and stage tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators.prefix import running_offset


def write_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = (), per_file: int = 1_000_000) -> None:
    """One JSON object per line, gzip; bounded rows per file, so a hot source has many files."""
    writer = df.write.option("compression", "gzip").option("maxRecordsPerFile", per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def folder_of(column: str) -> Column:
    """A value to name a folder after: an empty text and none would otherwise be one folder, and a task fail on it."""
    return F.concat(F.lit("of "), F.col(column).cast("string"))


def in_ranges(df: DataFrame, order: str, by: Sequence[str] = (), bits: int = 16) -> DataFrame:
    """Rows of one range of an integer key together and sorted, ranges spread over tasks.

    The range is the key's high bits, so no sampling pass runs the input a second time, and
    a source that holds most of the rows is still many ranges.
    """
    return df.repartition(*by, F.shiftright(order, bits)).sortWithinPartitions(*by, order)


def write_token_shards(
    df: DataFrame, path: str, order: str, shard: str | None = None, finish: Callable[[DataFrame], DataFrame] | None = None, bits: int = 16
) -> None:
    """Encoded rows with ids and masks side by side, in order within each file.

    ``finish`` is a projection of the rows that are in order, such as the one that fills them up to a
    length: what it adds is not moved or sorted. At most 2**``bits`` keys are a range.

    Ids and mask share a row, so they cannot drift apart. A hot shard is many files; sorting
    inside a file gives row groups that chunk reads can skip.
    """
    rows = in_ranges(df, order, [shard] if shard else [], bits)
    writer = (rows if finish is None else finish(rows)).write
    if shard:
        writer = writer.partitionBy(shard)
    writer.parquet(path)


def shard_by_size(
    df: DataFrame, key: str, size: Column, limit: int, by: Sequence[str] = ("source",), out: str = "shard"
) -> DataFrame:
    """Shard number per source: a document goes where it starts, every ``limit`` bytes a new shard."""
    placed = running_offset(df, key, weight=size, by=by, out="__start")
    return placed.withColumn(out, F.floor(F.col("__start") / F.lit(limit)).cast("bigint")).drop("__start")


def write_size_shards(
    df: DataFrame, path: str, key: str, size: Column, limit: int, by: Sequence[str] = ("source",)
) -> None:
    """JSON lines in one file per shard; a file ends with the document that reaches the limit.

    A file holds at most ``limit`` and one document. Numbers come from sizes alone; rows meet them by
    (``by``, ``key``), which is unique, and move to their shard's file. Folders are named after
    copies of ``by``, so the records keep their values, and after the shard.
    """
    sized = df.select(*by, key, size.cast("bigint").alias("__size"))
    numbered = shard_by_size(sized, key, F.col("__size"), limit, by, out="shard").drop("__size")
    names = {name: f"__of_{name}" for name in (*by, key)}
    numbered = numbered.withColumnsRenamed(names)
    same = [F.col(name).eqNullSafe(F.col(of)) for name, of in names.items()]
    placed = df.join(numbered, same).drop(*names.values()).withColumns({f"of_{name}": folder_of(name) for name in by})
    folders = [f"of_{name}" for name in by] + ["shard"]
    files = placed.repartition(*folders).sortWithinPartitions(*folders, key)
    files.write.partitionBy(*folders).option("compression", "gzip").json(path)


def write_data_order(order: DataFrame, path: str) -> None:
    """The global order as (position, instance_id), sorted within each file."""
    in_ranges(order.select("position", "instance_id"), "position").write.parquet(path)


def trace_lines(used: DataFrame) -> DataFrame:
    """One line per (rank, step): the step, then the instances in batch order, tab separated.

    A line holds one device batch, so the collected list is bounded by the batch size.
    """
    batch = F.array_sort(F.collect_list(F.struct("pos", "instance_id")))
    ids = F.transform(batch, lambda x: x["instance_id"].cast("string"))
    return (
        used.groupBy("rank", "step")
        .agg(ids.alias("ids"))
        .select("rank", "step", F.concat_ws("\t", F.col("step").cast("string"), F.array_join("ids", "\t")).alias("line"))
    )


def write_index_trace(used: DataFrame, path: str) -> None:
    """Gzip text per rank, steps in order within each file."""
    lines = in_ranges(trace_lines(used), "step", ["rank"])
    lines.select("rank", F.col("line").alias("value")).write.partitionBy("rank").option(
        "compression", "gzip"
    ).text(path)


def read_index_trace(spark: SparkSession, path: str) -> DataFrame:
    """The trace back as rows (rank, step, pos, instance_id)."""
    raw = spark.read.schema("value string, rank bigint").text(path)
    parts = F.split("value", "\t")
    return raw.select(
        F.col("rank").cast("bigint").alias("rank"),
        parts[0].cast("bigint").alias("step"),
        F.posexplode(F.slice(parts, F.lit(2), F.size(parts) - 1)).alias("pos", "instance"),
    ).select("rank", "step", F.col("pos").cast("bigint").alias("pos"), F.col("instance").cast("bigint").alias("instance_id"))


def furthest_stage(stages: DataFrame, key: str = "case_id", order: Sequence[str] = ("stage", "round")) -> DataFrame:
    """Per case the row of the furthest stage and latest round.

    A maximum over structs, combined before the shuffle, instead of a sorted window.
    """
    rest = [c for c in stages.columns if c not in (key, *order)]
    best = stages.groupBy(key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("best"))
    return best.select(key, "best.*")


def prefer_longer(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """The later stage's table unless an earlier stage holds more cases (two counts decide)."""
    return later if later.count() >= earlier.count() else earlier
