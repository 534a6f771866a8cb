"""Connected components of an edge table by alternating stars, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.session import stage


def star_forest(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not its component's smallest; ``edges`` has (a, b).

    Each round first hangs the larger neighbours of a node, then the smaller ones, below the
    smallest neighbour. Only edges move, minima combine before the shuffle, and the driver sees
    one yes or no per round. Loops are ignored; an empty table gives an empty table.
    """
    current = stage(_canonical(edges.select("a", "b")), "edges")
    while not _is_forest(current):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = _canonical(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        current = stage(_canonical(hung.select("e.a", "e.b")), "edges")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _is_forest(edges: DataFrame) -> bool:
    """No node hangs below two others, or below one and above another."""
    ends = edges.select(
        F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")
    ).select("e.*")
    ups = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return ups.where("up > 1 or (up > 0 and least = 0)").isEmpty()


def _canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end."""
    return (
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
