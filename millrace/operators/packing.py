"""Fixed-size chunks of a token stream, their global numbers, and finding them again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators.prefix import dense_position, running_offset
from millrace.sources.manifests import chunk_offsets


def pack_chunks(
    docs: DataFrame,
    chunk_size: int,
    shard: str = "source",
    order: str = "doc_id",
    arrays: Sequence[str] = ("input_ids",),
    size: str = "n_tokens",
) -> DataFrame:
    """(shard_id, chunk, arrays...): the shard's tokens in document order, cut into chunks.

    Documents may span chunks; a remainder shorter than a chunk is dropped per shard. Every
    document finds its start by a running total, cuts itself along the chunk borders it
    crosses, and only those pieces move: tokens are never exploded, and a chunk group never
    holds more than ``chunk_size`` tokens, however large its shard is.
    """
    filled = docs.where(F.col(size) > 0)
    # only sizes are put in order; the arrays meet their start by the document's key
    placed = filled.join(*_starts(filled, shard, order, size))
    lit = F.lit(chunk_size).cast("bigint")
    end = F.col("__start") + F.col(size)
    crossed = placed.withColumn("__end", end).select(
        F.col(shard).alias("shard_id"),
        "__start",
        "__end",
        *arrays,
        F.explode(F.sequence(F.floor(F.col("__start") / lit), F.floor((F.col("__end") - 1) / lit))).alias("chunk"),
    )
    # a projection of its own: there the slices are compiled and touch only what they keep
    begin = F.greatest(F.col("chunk") * lit, F.col("__start"))
    stop = F.least((F.col("chunk") + 1) * lit, F.col("__end"))
    at, n = (begin - F.col("__start") + 1).cast("int"), (stop - begin).cast("int")
    pieces = crossed.select(
        "shard_id", "chunk", begin.alias("begin"), *[F.slice(F.col(a), at, n).alias(a) for a in arrays]
    )
    merged = pieces.groupBy("shard_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("begin", *arrays))).alias("pieces")  # begin is unique
    )
    out = merged.select("shard_id", "chunk", *[F.flatten(F.col("pieces")[a]).alias(a) for a in arrays])
    return out.where(F.size(arrays[0]) == chunk_size)


def _starts(docs: DataFrame, shard: str, order: str, size: str) -> tuple[DataFrame, Column]:
    """(table with ``__start`` of every document among its shard's tokens, condition that joins it)."""
    starts = running_offset(docs.select(shard, order, size), order, weight=F.col(size), by=[shard], out="__start")
    starts = starts.select(F.col(shard).alias("__shard"), F.col(order).alias("__order"), "__start")
    return starts, F.col(order).eqNullSafe(F.col("__order")) & F.col(shard).eqNullSafe(F.col("__shard"))


def chunk_manifest(
    docs: DataFrame, chunk_size: int, shard: str = "source", size: str = "n_tokens", ordinal: Column | None = None
) -> DataFrame:
    """(path, ordinal, n_chunks, start, end) per shard that has a chunk, in ordinal order."""
    counted = docs.groupBy(F.col(shard).alias("path")).agg(
        F.floor(F.sum(size) / F.lit(chunk_size)).cast("bigint").alias("n_chunks")
    )
    listed = counted.where(F.col("n_chunks") > 0)
    listed = listed.withColumn("ordinal", F.col("path") if ordinal is None else ordinal)
    return chunk_offsets(listed)


def number_instances(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add the global instance number: the shard's start plus the chunk's place in it."""
    starts = manifest.select(F.col("path").alias("__path"), F.col("start").alias("__start"))
    return chunks.join(starts, F.col("shard_id").eqNullSafe(F.col("__path"))).withColumn(
        "instance_id", (F.col("__start") + F.col("chunk")).cast("bigint")
    ).drop("__path", "__start")


def instance_ids(manifest: DataFrame, name: str = "instance_id", piece: int = 1 << 16) -> DataFrame:
    """Every index that a file of the manifest covers, one a row; empty files cover none.

    A file is listed in stretches of ``piece`` indices first, which are dealt to all cores, so no row
    and no task holds all indices of a file.
    """
    stretches = manifest.where(F.col("end") > F.col("start")).select(
        "end", F.explode(F.sequence("start", F.col("end") - 1, F.lit(piece).cast("bigint"))).alias("__from")
    )
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    last = F.least(F.col("__from") + piece, F.col("end")) - 1
    return stretches.repartition(cores, "__from").select(F.explode(F.sequence("__from", last)).alias(name))


def locate_instance(requests: DataFrame, manifest: DataFrame, index: str = "index", strict: bool = True) -> DataFrame:
    """File and local index of global indices; negative ones count from the end.

    A range join turned into an equality join: the index space is cut into as many buckets
    as there are files, each file is listed under the buckets it overlaps (at most two per
    file on average), and a request looks into one bucket only.
    """
    total = manifest.agg(F.coalesce(F.max("end"), F.lit(0))).scalar()
    width = manifest.agg(F.greatest(F.ceil(F.max("end") / F.count(F.lit(1))), F.lit(1))).scalar()
    buckets = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    files = manifest.where(F.col("end") > F.col("start")).select("path", "start", "end", F.explode(buckets).alias("__bucket"))
    at = F.when(F.col(index) < 0, F.col(index) + total).otherwise(F.col(index))
    wanted = requests.withColumn("__pos", at)
    if strict:
        inside = (F.col("__pos") >= 0) & (F.col("__pos") < total)
        message = F.concat(F.col(index).cast("string"), F.lit(" is out of bounds"))
        wanted = wanted.withColumn("__pos", F.when(inside, F.col("__pos")).otherwise(F.raise_error(message).cast("bigint")))
    wanted = wanted.withColumn("__bucket", F.floor(F.col("__pos") / width))
    return (
        wanted.join(files, "__bucket")
        .where((F.col("start") <= F.col("__pos")) & (F.col("__pos") < F.col("end")))
        .withColumn("local_index", (F.col("__pos") - F.col("start")).cast("bigint"))
        .select(*requests.columns, "path", "local_index")
    )


def concat_manifests(first: DataFrame, second: DataFrame) -> DataFrame:
    """The files of one dataset after those of another, with new offsets.

    Masks and settings of both are kept; they live in the chunk rows themselves.
    """
    shift = first.agg(F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).scalar()
    moved = second.withColumn("ordinal", F.col("ordinal") + shift)
    keep = ["path", "ordinal", "n_chunks"]
    return chunk_offsets(first.select(*keep).unionByName(moved.select(*keep)))


def concat_splits(df: DataFrame, split: str, listed: Sequence[str | int], key: str, out: str = "position") -> DataFrame:
    """Concatenate splits in listed order, each in key order; unlisted ones are left out."""
    spark: SparkSession = df.sparkSession
    kind = df.schema[split].dataType.simpleString()
    order = spark.createDataFrame([(v, i) for i, v in enumerate(listed)], f"`{split}` {kind}, ordinal bigint")
    rows = df.join(order, split)
    sizes = rows.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_chunks"))
    starts = chunk_offsets(sizes).select("ordinal", "start")
    placed = dense_position(rows, key, by=["ordinal"], out="__in_split")
    return placed.join(starts, "ordinal").withColumn(out, (F.col("start") + F.col("__in_split")).cast("bigint")).drop(
        "start", "__in_split"
    )


def consecutive_groups(values: DataFrame, value: str, step: int = 1) -> DataFrame:
    """(first, last, n) of the runs of ordered integers that differ by ``step``."""
    placed = dense_position(values.select(value), value, out="__pos")
    before = placed.select((F.col("__pos") + 1).alias("__pos"), F.col(value).alias("__before"))
    marked = placed.join(before, "__pos", "left").withColumn(
        "__new", F.coalesce((F.col(value) - F.col("__before") != step).cast("bigint"), F.lit(1))
    )
    runs = running_offset(marked, "__pos", weight=F.col("__new"), out="__run")
    return runs.groupBy((F.col("__run") + F.col("__new")).alias("__run")).agg(
        F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n")
    ).drop("__run")
