"""Manifests: which file belongs to which label, and where its instances start."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def build_manifest(
    spark: SparkSession,
    paths: Sequence[str] | None = None,
    datasets: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """(ordinal, path, label): a path list, or groups visited in sorted label order."""
    if paths and datasets:
        raise ValueError("paths and datasets are mutually exclusive")
    if paths:
        rows = [(i, p, None) for i, p in enumerate(paths)]
    elif datasets:
        flat = [(label, p) for label in sorted(datasets) for p in datasets[label]]
        rows = [(i, p, label) for i, (label, p) in enumerate(flat)]
    else:
        raise ValueError("one of paths or datasets is required")
    return spark.createDataFrame(rows, "ordinal bigint, path string, label string")


def manifest_of(df: DataFrame, path: str, label: Column | None = None, weight: Column | None = None) -> DataFrame:
    """(path, label, n) from the rows themselves: one row per file, files counted or weighed."""
    label = F.lit(None).cast("string") if label is None else label
    weight = F.lit(1) if weight is None else weight
    return df.groupBy(F.col(path).alias("path"), label.alias("label")).agg(F.sum(weight).cast("bigint").alias("n"))


def attach_metadata(chunks: DataFrame, manifest: DataFrame, on: str = "path") -> DataFrame:
    """Add the metadata map of each chunk's file: its label when grouped, else its path."""
    meta = F.when(F.col("__label").isNotNull(), F.create_map(F.lit("label"), F.col("__label"))).otherwise(
        F.create_map(F.lit("path"), F.col(on))
    )
    labels = manifest.select(F.col("path").alias(on), F.col("label").alias("__label"))
    return chunks.join(labels, on, "inner").withColumn("metadata", meta).drop("__label")


def chunk_offsets(manifest: DataFrame, chunks: str = "n_chunks", order: str = "ordinal") -> DataFrame:
    """(start, end) of every file's instances: running sums in file order.

    The window has no partition because it runs over file names only, never over data.
    """
    window = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        manifest.withColumn("end", F.sum(chunks).over(window))
        .withColumn("start", F.col("end") - F.col(chunks))
    )
