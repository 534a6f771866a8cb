"""From documents to the batches of every rank, and from a place in the order to its instance.

Where each token goes is decided on lengths alone. Tokens then move once, to their batch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.ordering import rank_stripe, seeded_order
from millrace.operators.packing import _starts, chunk_manifest, number_instances
from millrace.session import stage

# Documents whose places may be broadcast (some 40 bytes each, and more for long ones).
INDEX_ROWS = 1 << 20
ROUNDS = 4
WALK = 64


def place_pieces(lengths: DataFrame, chunk_size: int, world: int, batch: int, seed: int, shard: str = "source", order: str = "doc_id", size: str = "n_tokens", epoch: int = 0) -> DataFrame:
    """(shard, order, pieces): per document where its tokens go, as (rank, step, place, at, begin, n, instance_id).

    A piece is the ``n`` tokens from ``begin`` (0-based) of the document, which stand from ``at`` on in
    the ``place``-th instance of the batch. Instances are the shards' chunks in seeded order, cut to a
    multiple of ``world``; tokens of no whole chunk or beyond the cut have no piece. A document has a
    piece per chunk that it reaches into.
    """
    filled = lengths.where(F.col(size) > 0).select(shard, order, size)
    manifest = stage(chunk_manifest(filled, chunk_size, shard, size), "manifest")
    total = F.coalesce(manifest.agg(F.max("end")).scalar(), F.lit(0))
    starts, _ = _starts(filled, shard, order, size)
    joined = starts.join(filled.select(F.col(shard).alias("__s"), F.col(order).alias("__o"), F.col(size).alias("__n")),
                         F.col("__shard").eqNullSafe(F.col("__s")) & F.col("__order").eqNullSafe(F.col("__o")))
    end = F.col("__start") + F.col("__n")
    crossed = joined.select(
        F.col("__shard").alias("shard_id"), "__order", "__start", end.alias("__end"),
        F.explode(F.sequence(F.floor(F.col("__start") / chunk_size), F.floor((end - 1) / chunk_size))).alias("chunk"),
    )
    first = F.greatest(F.col("chunk") * chunk_size, F.col("__start"))
    last = F.least((F.col("chunk") + 1) * chunk_size, F.col("__end"))
    pieces = crossed.select(
        "shard_id", "__order", "chunk", (first - F.col("__start")).alias("begin"), (first - F.col("chunk") * chunk_size).alias("at"), (last - first).alias("n")
    )
    whole = manifest.select(F.col("path").alias("__path"), "n_chunks")
    pieces = pieces.join(whole, F.col("shard_id").eqNullSafe(F.col("__path"))).where("chunk < n_chunks").drop("__path", "n_chunks")
    pieces = stage(number_instances(pieces, manifest), "pieces")
    # exactly one piece begins a chunk, so instances need no list of numbers
    placed = rank_stripe(seeded_order(pieces.where("at = 0").select("instance_id"), seed, epoch=epoch), world)
    placed = placed.where(F.col("position") < total - total % world).select(
        "instance_id", "rank", F.floor(F.col("local") / batch).cast("bigint").alias("step"), (F.col("local") % batch).alias("place")
    )
    fields = ["rank", "step", "place", "at", "begin", "n", "instance_id"]
    listed = pieces.join(placed, "instance_id").groupBy("shard_id", "__order").agg(F.collect_list(F.struct(*fields)).alias("pieces"))
    return listed.withColumnsRenamed({"shard_id": shard, "__order": order})


def rank_batches(docs: DataFrame, chunk_size: int, world: int, batch: int, seed: int, shard: str = "source", order: str = "doc_id", ids: str = "input_ids", size: str = "n_tokens", epoch: int = 0) -> DataFrame:
    """(rank, step, instance_ids, input_ids): encoded documents as the batches of an epoch.

    ``input_ids`` is an array of ``chunk_size`` tokens per instance, in the order of ``instance_ids``; the last
    batch of a rank may be short. ``docs`` is read twice, first its lengths, so it should be a written table.
    (``shard``, ``order``) is unique. While the places are of at most ``INDEX_ROWS`` documents they go
    to all tasks and only the exchange to the batches carries tokens; beyond that, places
    and documents meet by their key first.
    """
    places = stage(place_pieces(docs, chunk_size, world, batch, seed, shard, order, size, epoch), "places")
    named = places.select(F.col(shard).alias("__shard"), F.col(order).alias("__order"), "pieces")
    if places.count() <= INDEX_ROWS:
        named = F.broadcast(named)
    same = F.col(order).eqNullSafe(F.col("__order")) & F.col(shard).eqNullSafe(F.col("__shard"))
    cut = docs.join(named, same).select(ids, F.explode("pieces").alias("p"))
    moved = cut.select("p.rank", "p.step", "p.place", "p.at", "p.instance_id", F.slice(ids, (F.col("p.begin") + 1).cast("int"), F.col("p.n").cast("int")).alias("part"))
    # a batch is bounded by its size
    grouped = moved.groupBy("rank", "step").agg(F.array_sort(F.collect_list(F.struct("place", "at", "instance_id", "part"))).alias("parts"))
    heads = F.filter("parts", lambda x: x["at"] == 0)
    tokens = grouped.select("rank", "step", F.transform(heads, lambda x: x["instance_id"]).alias("instance_ids"), F.flatten(F.col("parts.part")).alias("__all"))
    return tokens.select(
        "rank", "step", "instance_ids",
        F.transform("instance_ids", lambda _, i: F.slice("__all", i * chunk_size + 1, chunk_size)).alias("input_ids"),
    )


# --- a permutation that needs no table ---------------------------------------------------


def _round_value(seed: int, epoch: Column, number: int, half: Column) -> Column:
    """32 bits of a seeded md5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), F.lit(number).cast("string"), half.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _sides(n: int) -> tuple[int, int]:
    rows = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return rows, max(1, -(-n // rows))


def _turn(number: int, way: int, rows: int, columns: int, seed: int, epoch: Column):
    """One round: the first half moves in even ones, the second in odd ones."""

    def turn(s: Column) -> Column:
        if number % 2 == 0:
            return F.struct(F.pmod(s["a"] + way * _round_value(seed, epoch, number, s["b"]), F.lit(rows)).alias("a"), s["b"].alias("b"))
        return F.struct(s["a"].alias("a"), F.pmod(s["b"] + way * _round_value(seed, epoch, number, s["a"]), F.lit(columns)).alias("b"))

    return turn


def _once(value: Column, n: int, seed: int, epoch: Column, back: bool) -> Column:
    """Numbers below rows * columns as a pair; each round moves one half by what the other says."""
    rows, columns = _sides(n)
    state = F.struct(F.floor(value / columns).cast("bigint").alias("a"), (value % columns).cast("bigint").alias("b"))
    for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
        turn = _turn(number, -1 if back else 1, rows, columns, seed, epoch)
        state = F.transform(F.array(state), turn)[0]  # a lambda names the state once
    return F.transform(F.array(state), lambda s: s["a"] * columns + s["b"])[0]


def _walked(value: Column, n: int, seed: int, epoch: Column, back: bool) -> Column:
    """Again while the result is not below ``n``: fewer numbers than rows lie beyond, and none comes twice."""
    rows, columns = _sides(n)
    steps = min(rows * columns - n, WALK)
    out = _once(value, n, seed, epoch, back)
    if steps == 0:
        return out
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), out, lambda x, _: F.when(x < n, x).otherwise(_once(x, n, seed, epoch, back)))
    return F.transform(F.array(walk), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("the walk has not ended")).cast("bigint")))[0]


def instance_at(position: Column, n: int, seed: int, epoch: Column) -> Column:
    """The instance at a place of the epoch's order of ``n`` instances: a bijection of 0 to n - 1, row by row."""
    return _walked(position.cast("bigint"), n, seed, epoch, False)


def position_of(instance: Column, n: int, seed: int, epoch: Column) -> Column:
    """The place of an instance; undoes ``instance_at``."""
    return _walked(instance.cast("bigint"), n, seed, epoch, True)


def batch_instances(steps: DataFrame, n: int, world: int, batch: int, seed: int) -> DataFrame:
    """(epoch, rank, step, place, instance_id) of wanted batches (epoch, rank, step): no order is made, sorted or read.

    The order is cut to a multiple of ``world``; places beyond its end are left out.
    """
    local = F.col("step") * batch + F.col("place")
    places = steps.select("epoch", "rank", "step", F.explode(F.sequence(F.lit(0), F.lit(batch - 1))).alias("place"))
    placed = places.withColumn("__position", local * world + F.col("rank")).where(F.col("__position") < n - n % world)
    return placed.select(
        "epoch", "rank", "step", F.col("place").cast("bigint").alias("place"), instance_at(F.col("__position"), n, seed, F.col("epoch")).alias("instance_id")
    )
