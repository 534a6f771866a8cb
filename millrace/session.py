"""Session builder and the shared folder that written tables go to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # runs of identical-key aggregates stay hash based a little longer
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, cores: int | None = None, **conf: str) -> SparkSession:
    """A session with this package's defaults; sizes come from the cluster unless given."""
    builder = SparkSession.builder.appName("millrace")
    if master is None and cores is not None:
        master = f"local[{cores}]"
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    if cores is not None:
        settings["spark.sql.shuffle.partitions"] = str(cores)
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    use_local_folder(spark)
    ship(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder written tables go to: ``spark.checkpoint.dir`` or the context's own.

    An unset folder is an error: every executor has to reach it. See ``use_local_folder``.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder.rstrip("/")


def use_local_folder(spark: SparkSession) -> None:
    """Give a session in one machine, such as a test's, a folder of its own if it has none."""
    context = spark.sparkContext
    unset = spark.conf.get("spark.checkpoint.dir", None) is None and not context.getCheckpointDir()
    if unset and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, so that they need no path of their own."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "millrace")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(target)  # Spark's own file server hands it out


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input has fewer splits than the cluster has cores.

    For plain scans. A small file is often one row group and so one task, however heavy the
    work per row. A large input has splits enough and is left as it is, so this never
    shuffles one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python functions a few megabytes at a time: what a function makes of a batch is many times its bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stage(df: DataFrame, name: str = "stage", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation, and keeps
    column pruning and filter pushdown for everything downstream.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
