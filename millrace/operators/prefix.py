"""Running totals and dense positions without a one-task window.

A window over a whole table, or over one source that holds a third of it, runs in a single
task. Here rows are windowed inside narrow key ranges, the ranges are totalled, and the
totals are added up level by level. The ranges come from the key itself (its high bits), so
they are the same on every run and after every retry, and no sampling pass is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# A unique bigint key: at most 2**16 rows share a range, and 2**16 ranges a parent.
INTEGER_KEY = (16, 32, 48)
# A 60-bit hash key: 2**16 ranges of equal expected size, whatever the data.
HASH_KEY = (44,)
# A dense key from 0 on, such as a position: 2**16 rows a range, all ranges in one narrow window.
DENSE_KEY = (16,)


def _ranges(df: DataFrame, key: str, by: Sequence[str], shifts: Sequence[int]) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with the groups of ``by`` and the ranges of ``key`` as columns without nulls, and their names.

    Ranges are joined by equality, which a null would fail.
    """
    groups: dict[str, Column] = {}
    for i, field in enumerate(df.schema[name] for name in by):
        value, kind = F.col(field.name), field.dataType.simpleString()
        groups[f"__by{i}"] = value
        if field.nullable:
            whole = kind in ("tinyint", "smallint", "int", "bigint")
            groups[f"__by{i}"] = F.coalesce(value, F.lit(0)) if whole else F.coalesce(value.cast("string"), F.lit(""))
            groups[f"__none{i}"] = value.isNull()
    nodes = {f"__node{i}": F.coalesce(F.shiftright(F.col(key), bits), F.lit(-1 << 62)) for i, bits in enumerate(shifts)}
    return df.withColumns({**groups, **nodes}), list(groups), list(nodes)


def running_offset(
    df: DataFrame,
    key: str,
    weight: Column | None = None,
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    out: str = "offset",
    shifts: Sequence[int] = INTEGER_KEY,
) -> DataFrame:
    """Add the exclusive running sum of ``weight`` in ``key`` order within ``by``.

    ``weight`` defaults to 1, which makes ``out`` a dense position starting at 0.
    ``ties`` order rows of equal key. Nulls in ``by`` are a group like any other, a null key comes
    before all others. All columns of ``df`` travel with the window, so hand in only those that
    are needed.
    """
    return running_offsets(df, key, {out: F.lit(1) if weight is None else weight}, by, ties, shifts)


def running_offsets(
    df: DataFrame,
    key: str,
    weights: Mapping[str, Column],
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    shifts: Sequence[int] = INTEGER_KEY,
) -> DataFrame:
    """Several running sums over the same order in one pass: output name to weight."""
    outs = list(weights)
    tagged, by, node = _ranges(df, key, by, shifts)
    tagged = tagged.withColumns({f"__w_{name}": weight.cast("bigint") for name, weight in weights.items()})

    def exclusive_sums(rows: DataFrame, part: list[str], order: list[str], prefix: str) -> DataFrame:
        window = Window.partitionBy(*part).orderBy(*order)
        frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = {f"{prefix}{o}": F.sum(f"__w_{o}").over(frame) - F.col(f"__w_{o}") for o in outs}
        return rows.withColumns(sums)

    totals = [F.sum(f"__w_{o}").alias(f"__w_{o}") for o in outs]
    local = exclusive_sums(tagged, [*by, node[0]], [key, *ties], "__l_")
    level = tagged.groupBy(*by, *node).agg(*totals)
    offsets: DataFrame | None = None
    for i in range(len(node)):
        parents = node[i + 1 :]
        ranged = exclusive_sums(level, [*by, *parents[:1]], [node[i]], "__s_")
        if offsets is None:
            offsets = ranged.select(*by, *node, *[F.col(f"__s_{o}").alias(f"__o_{o}") for o in outs])
        else:
            starts = ranged.select(*by, node[i], *[f"__s_{o}" for o in outs])
            offsets = offsets.join(starts, [*by, node[i]]).withColumns(
                {f"__o_{o}": F.col(f"__o_{o}") + F.col(f"__s_{o}") for o in outs}
            ).drop(*[f"__s_{o}" for o in outs])
        if parents:
            level = level.groupBy(*by, *parents).agg(*totals)
    offsets = offsets.select(*by, node[0], *[f"__o_{o}" for o in outs])
    return local.join(offsets, [*by, node[0]]).select(
        *df.columns, *[(F.col(f"__l_{o}") + F.col(f"__o_{o}")).alias(o) for o in outs]
    )


def dense_position(df: DataFrame, key: str, by: Sequence[str] = (), out: str = "position") -> DataFrame:
    """Dense 0-based position in the order of a unique integer key."""
    return running_offset(df, key, by=by, out=out)


def hashed_position(
    df: DataFrame, digest: Column, ties: Sequence[str], by: Sequence[str] = (), out: str = "position"
) -> DataFrame:
    """Dense 0-based position in the order of an md5 text, then ``ties``."""
    tagged = df.withColumn("__md5", digest).withColumn(
        "__h", F.conv(F.substring("__md5", 1, 15), 16, 10).cast("bigint")
    )
    placed = running_offset(tagged, "__h", by=by, ties=["__md5", *ties], out=out, shifts=HASH_KEY)
    return placed.drop("__md5", "__h")


def running_minimum(
    df: DataFrame, key: str, value: str, by: Sequence[str] = (), out: str = "running_min", shifts: Sequence[int] = INTEGER_KEY
) -> DataFrame:
    """Add the inclusive running minimum of ``value`` in order of a unique integer key.

    Minima of key ranges are passed on in the same way as the totals of ``running_offset``.
    """
    tagged, by, node = _ranges(df, key, by, shifts)

    def window(part: list[str], order: str, last: int):
        return Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, last)

    local = tagged.withColumn(out, F.min(value).over(window([*by, node[0]], key, 0))).drop(*node[1:])
    level = tagged.groupBy(*by, *node).agg(F.min(value).alias("__m"))
    before = None
    for i in range(len(node)):
        parents = node[i + 1 :]
        earlier = level.withColumn("__e", F.min("__m").over(window([*by, *parents[:1]], node[i], -1)))
        if before is None:
            before = earlier.select(*by, *node, F.col("__e").alias("__before"))
        else:
            before = before.join(earlier.select(*by, node[i], "__e"), [*by, node[i]]).withColumn(
                "__before", F.least("__before", "__e")
            ).drop("__e")
        if parents:
            level = level.groupBy(*by, *parents).agg(F.min("__m").alias("__m"))
    return (
        local.join(before.select(*by, node[0], "__before"), [*by, node[0]])
        .withColumn(out, F.least(out, "__before"))
        .select(*df.columns, out)
    )


def trailing_blocks(df: DataFrame, position: str, size: int, block: int = 1 << 14) -> DataFrame:
    """Rows in blocks of positions, each block led by the ``size - 1`` rows before it.

    Adds ``__block`` and ``__context``. A frame of the last ``size`` rows can then be taken per
    block, in parallel, and the context rows dropped: exact, however long the sequence is.
    """
    block = max(block, size)
    home = F.floor(F.col(position) / block).cast("bigint")
    own = F.struct(home.alias("block"), F.lit(False).alias("context"))
    ahead = F.struct((home + 1).alias("block"), F.lit(True).alias("context"))
    reaches = F.col(position) % block > block - size
    return (
        df.withColumn("__b", F.explode(F.when(reaches, F.array(own, ahead)).otherwise(F.array(own))))
        .withColumn("__block", F.col("__b.block"))
        .withColumn("__context", F.col("__b.context"))
        .drop("__b")
    )
