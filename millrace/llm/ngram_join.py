"""Self-join of documents on the Jaccard similarity of their word shingles.

A set of shingles is a class with all documents that have it. Classes are brought together
without loss by the pigeonhole principle: two similar sets differ in at most ``r`` shingles, so
when both are cut into more than ``r`` parts of the hash range, some part is the same in both.
Classes that share a part, and whose counts of hashes allow them to be similar, form blocks; in each block a packed R-tree over group counts bounds the
overlap of pairs by summed coordinate minima, and what survives is verified on the sets. Only
links that join components are returned, so a group of near copies never becomes all its pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.components import star_forest
from millrace.llm.count_rtree import allowed_forest, fine_counts, linked, may_link
from millrace.llm.words import mix, shingle_sets
from millrace.session import stage

# Most classes and bytes of hashes of a tile, which one task compares.
TILE = 8192
TILE_BYTES = 48 << 20
SEEN = 1 << 18
PART_ROWS = 1 << 18
# Most classes of a part that are compared by their counts; those of a wider part are all in one block.
WIDE = 8192
# Groups of up to so many classes are compared many at a time.
FEW = 32
BROADCAST_ROWS = 1 << 20
# Shingle sets below this size are brought together by single shingles of their prefix.
SMALL = 32


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): groups of documents that links connect.

    Two documents link when 100 * intersection >= ``percent`` * union of their distinct
    ``size``-word shingles. A text of fewer words has its whole sequence as one shingle. A text
    without words, empty or null, has none and links with nothing: its component is its own id.
    Rows of equal text link with each other. A repeated ``doc_id`` keeps its rows; a text
    that only rows with a null id have gets no links to other texts. Other columns are
    ignored. An empty table gives none.
    """
    texts = docs.select("doc_id", "text")
    sets = texts.mapInArrow(lambda batches: _classes(batches, size), "doc_id bigint, n_shingles bigint, class bigint, counts binary")
    sets = stage(sets, "shingle-sets")
    parts = texts.select("text").mapInArrow(lambda batches: _parts(batches, size, percent), "part bigint, class bigint")
    hints = stage(_hints(stage(_shared_parts(parts), "shared-parts"), sets, percent), "block-hints")
    blocks = star_forest(hints)
    blocks = blocks.unionByName(blocks.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "block")
    links = stage(_links(docs, sets, blocks, size, percent), "links")
    forest = star_forest(links)
    roots = forest.unionByName(forest.select(F.col("root").alias("node"), "root").distinct())
    firsts = sets.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    classes = firsts.join(roots.withColumnRenamed("node", "class"), "class", "left")
    least = classes.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least_id"))
    classes = (
        classes.where("root is not null or copies > 1").join(least, "root", "left")
        .select("class", F.coalesce("least_id", "first_id").alias("component_id"))
    )
    return sets.join(classes, "class", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are not the smallest ``doc_id`` of their group.

    Documents with a null id stay; of rows that repeat one id all stay or all go.
    """
    later = near_groups(docs, size, percent).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def _classes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(len(h), class_of(h), fine_counts(h).tobytes()) for h in shingle_sets(batch.column("text"), size)]
        numbers = np.array([f[:2] for f in found], np.int64).reshape(-1, 2)
        yield pa.record_batch(
            [
                batch.column("doc_id").cast(pa.int64()), pa.array(np.ascontiguousarray(numbers[:, 0])),
                pa.array(np.ascontiguousarray(numbers[:, 1])), pa.array([f[2] for f in found], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "class", "counts"],
        )


def _parts(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """A row per class and part; once per class and task is enough, and forgetting only repeats it."""
    seen: set[int] = set()
    for batch in batches:
        keys, names, held = [], [], 0
        for hashes in shingle_sets(batch.column("text"), size):
            name = class_of(hashes)
            if len(hashes) and name not in seen:
                own = part_keys(hashes, percent)
                keys.append(own)
                names.append(np.full(len(own), name))
                held += len(own)
            if len(seen) > SEEN:
                seen.clear()
            seen.add(name)
            if held >= PART_ROWS:
                yield _part_rows(keys, names)
                keys, names, held = [], [], 0
        if keys:
            yield _part_rows(keys, names)


def _part_rows(keys: list[np.ndarray], names: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(names), pa.int64())], names=["part", "class"])


def class_of(hashes: np.ndarray) -> int:
    """A 64-bit name of a set of 64-bit hashes."""
    place = np.arange(1, len(hashes) + 1, dtype=np.uint64)
    total = mix(hashes + place * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) if len(hashes) else np.uint64(0)
    return int(mix(np.array([total], np.uint64) + np.uint64(len(hashes))).view(np.int64)[0])


@functools.lru_cache(maxsize=None)
def size_class(number: int, percent: int) -> tuple[int, int, int]:
    """(largest size, parts, spare parts) of a size class; a class spans one step of similarity.

    Of m parts at most ``differ`` are not the same in two similar sets of the class. The spare
    ones let a set leave out its empty parts, which say little, while it has no more of them.
    """
    low = SMALL if number == 0 else size_class(number - 1, percent)[0] + 1
    high = low * 100 // percent
    differ = 2 * high * (100 - percent) // (100 + percent)
    spare = 1
    for _ in range(64):
        m = differ + 1 + spare
        empty = m * math.exp(-low * percent / 100 / m)
        wanted = math.ceil(empty + 2 * math.sqrt(empty))
        if wanted <= spare:
            return high, differ + 1 + spare, spare
        spare = wanted
    return high, differ + 1, 0


def part_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Keys such that every two sets of the given similarity have one in common.

    A set takes the parts of its own size class and of the next, where the largest sets that it
    can match are; but not its empty parts, which would be the same in unrelated sets. A set of
    ``SMALL`` or more without too many of those shares a filled part with whatever is similar. Any
    two others share a shingle of their prefixes, which they take as well.
    """
    n = len(hashes)
    keys, number, sparse = [], 0, n < SMALL
    if sparse:
        wanted = [0] if n * 100 >= SMALL * percent else []
    else:
        while size_class(number, percent)[0] < n:
            number += 1
        wanted = [number, number + 1]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)))
    for number in wanted:
        _, m, spare = size_class(number, percent)
        edges = np.arange(1, m, dtype=np.uint64) * np.uint64((1 << 64) // m)
        cuts = np.concatenate(([0], np.searchsorted(hashes, edges), [n]))
        salt = np.uint64(number * 0x2545F4914F6CDD1D % (1 << 64)) + np.arange(m, dtype=np.uint64) * np.uint64(0x165667B19E3779F9)
        key = mix(mix(sums[cuts[1:]] - sums[cuts[:-1]] + salt) ^ salt)
        filled = cuts[1:] > cuts[:-1]
        keys.append(key[filled])
        sparse |= m - filled.sum() > spare
    if sparse:
        keys.append(hashes[: n - -(-n * percent // 100) + 1])
    return np.concatenate(keys).view(np.int64)


def _shared_parts(parts: DataFrame) -> DataFrame:
    """(group, class, first): the classes of every part that several have, once for all parts of the same classes.

    A part of more than ``WIDE`` classes has no group, but its first class beside each other one.
    """
    runs = parts.repartition("part").sortWithinPartitions("part", "class")
    return runs.mapInArrow(_runs, "group bigint, class bigint, first bigint").distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted (part, class) rows; keeps the last run, or only its part and first class once it is wide."""
    keys, names = np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = None
    for batch in batches:
        keys = np.concatenate((keys, batch.column("part").to_numpy(zero_copy_only=False)))
        names = np.concatenate((names, batch.column("class").to_numpy(zero_copy_only=False)))
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])))[: len(keys)]
        keys, names = keys[new], names[new]
        if wide is not None:
            more = int(np.searchsorted(keys != wide[0], True)) if len(keys) else 0
            yield _run_rows(None, names[:more][names[:more] != wide[1]], wide[1])
            keys, names = keys[more:], names[more:]
            if not len(keys):
                continue
            wide = None
        last = int(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[-1]) if len(keys) else 0
        yield _groups(keys[:last], names[:last])
        keys, names = keys[last:], names[last:]
        if len(keys) > WIDE:
            wide = int(keys[0]), int(names[0])
            yield _run_rows(None, names[1:], wide[1])
            keys, names = keys[:0], names[:0]
    yield _groups(keys, names)


def _groups(keys: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """Rows of the runs of several classes; runs of the same classes have one group, and come once."""
    if not len(keys):
        return _run_rows(names, names)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lengths = np.diff(np.concatenate((starts, [len(keys)])))
    several = lengths > 1
    names, lengths = names[np.repeat(several, lengths)], lengths[several]
    if not len(names):
        return _run_rows(names, names)
    groups = mix(np.add.reduceat(mix(names.view(np.uint64)), np.cumsum(lengths) - lengths) + lengths.astype(np.uint64)).view(np.int64)
    once = np.zeros(len(groups), bool)
    once[np.unique(groups, return_index=True)[1]] = True
    return _run_rows(np.repeat(groups[once], lengths[once]), names[np.repeat(once, lengths)])


def _run_rows(groups: np.ndarray | None, names: np.ndarray, first: int | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(names), pa.int64())
    return pa.record_batch(
        [none if groups is None else pa.array(groups), pa.array(names), none if first is None else pa.array(np.full(len(names), first))],
        names=["group", "class", "first"],
    )


def _hints(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect all classes which share a part and whose counts allow them to be similar."""
    members = shared.where("group is not null").select("group", "class")
    counts = sets.where("n_shingles > 0").join(members.select("class").distinct(), "class", "left_semi")
    counts = counts.groupBy("class").agg(F.first("counts").alias("counts"))
    rows = members.join(counts, "class").repartition("group").sortWithinPartitions("group")
    met = rows.select("group", "class", "counts").mapInArrow(lambda batches: _allowed(batches, percent), "a bigint, b bigint")
    return shared.where("group is null").select(F.col("first").alias("a"), F.col("class").alias("b")).unionByName(met).distinct()


def _allowed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by group; keeps the last group."""
    groups, names, points = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for batch in batches:
        groups = np.concatenate((groups, batch.column("group").to_numpy(zero_copy_only=False)))
        names = np.concatenate((names, batch.column("class").to_numpy(zero_copy_only=False)))
        points += [np.frombuffer(c.as_buffer(), np.int32) for c in batch.column("counts")]
        last = int(np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))[-1]) if len(groups) else 0
        yield _allowed_pairs(groups[:last], names[:last], points[:last], percent)
        groups, names, points = groups[last:], names[last:], points[last:]
    yield _allowed_pairs(groups, names, points, percent)


def _allowed_pairs(groups: np.ndarray, names: np.ndarray, points: list[np.ndarray], percent: int) -> pa.RecordBatch:
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))[: len(groups)])
    lengths = np.diff(np.concatenate((starts, [len(groups)])))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length in np.unique(lengths[lengths <= FEW]).tolist():
        own = starts[lengths == length][:, None]
        i, j = np.triu_indices(length, 1)
        left.append((own + i).ravel())
        right.append((own + j).ravel())
    left, right = np.concatenate(left), np.concatenate(right)
    good = may_link(points, left, right, percent, 100)
    left, right = left[good], right[good]
    for start, length in zip(starts[lengths > FEW].tolist(), lengths[lengths > FEW].tolist()):
        found = np.array(allowed_forest(points[start : start + length], percent, 100), np.int64).reshape(-1, 2) + start
        left, right = np.concatenate((left, found[:, 0])), np.concatenate((right, found[:, 1]))
    pairs = np.unique(np.stack((names[left], names[right])), axis=1)
    return pa.record_batch([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])


def _links(docs: DataFrame, sets: DataFrame, blocks: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links (a, b) between classes, enough to connect each component.

    Similar sets are of similar size, so a block is cut into bands of sizes, one step of similarity wide:
    a class meets those of its own band and of the next. A band with the one below it is a tile while it is small; a
    larger one is cut into sides by hash, as many as its classes and its bytes ask for, and every two
    sides are a tile.
    """
    firsts = sets.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    members = stage(
        blocks.join(firsts, blocks["node"] == firsts["class"]).select("doc_id", "class", "block", "n", band_of(F.col("n"), percent).alias("band")),
        "block-members",
    )
    sizes = members.groupBy("block", "band").agg(F.count("*").alias("own"), F.sum("n").alias("hashes"))
    below = sizes.select("block", (F.col("band") + 1).alias("band"), F.col("own").alias("low_own"), F.col("hashes").alias("low_hashes"))
    sizes = sizes.join(below, ["block", "band"], "left").na.fill(0)
    sides = F.ceil(F.greatest(
        (F.col("own") + F.col("low_own")) / F.lit(TILE // 2), (F.col("hashes") + F.col("low_hashes")) * 8 / F.lit(TILE_BYTES // 2)
    )).cast("int")
    # a class alone in its bands has nobody to meet
    groups = sizes.where("own + low_own > 1").select("block", "band", sides.alias("sides"))
    groups = stage(groups, "block-bands")
    reach = F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band")
    listed = members.select("doc_id", "class", "block", reach).join(groups, ["block", "band"])
    chosen = listed.groupBy("doc_id", "class").agg(F.collect_list(F.struct("block", "band", "sides")).alias("groups"))  # two at most
    chosen = stage(chosen, "block-groups")
    small = chosen.count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen) if small else chosen, "doc_id")
    hashed = rows.mapInArrow(lambda b: _sets(b, size), "class bigint, groups array<struct<block:bigint,band:int,sides:int>>, hashes binary")
    hashed = hashed.select("class", "hashes", F.explode("groups").alias("g")).select("class", "hashes", "g.*")
    side = F.pmod(F.xxhash64("class"), F.col("sides")).cast("int")
    pairs = F.when(F.col("sides") <= 2, F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("sides") - 1),
            lambda other: F.struct(F.least(other, side).alias("low"), F.greatest(other, side).alias("high")),
        )
    )
    tiles = hashed.withColumn("side", side).withColumn("tile", F.explode(pairs)).select(
        "block", "band", F.col("tile.low").alias("low"), F.col("tile.high").alias("high"), "side", "class", "hashes"
    )
    return tiles.groupBy("block", "band", "low", "high").applyInArrow(lambda table: _tile(table, percent), "a bigint, b bigint").distinct()


def band_of(n: Column, percent: int) -> Column:
    """Number of the band of a set's size: of two similar sets the larger is in the same band or the next."""
    if percent >= 100:
        return n.cast("int")
    return F.floor(F.log(n.cast("double")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(shingle_sets(batch.column("text"), size))
        # a row that repeats the id with another text is not the class asked for
        own = [class_of(h) == c for h, c in zip(found, batch.column("class").to_pylist())]
        kept = pa.array([h.tobytes() for h, same in zip(found, own) if same], pa.binary())
        rest = batch.select(["class", "groups"]).filter(pa.array(own, pa.bool_()))
        yield pa.record_batch([*rest.columns, kept], names=["class", "groups", "hashes"])


def _tile(table: pa.Table, percent: int) -> pa.Table:
    """Links of one tile; the hashes stay in the buffers in which they came."""
    names = table.column("class").to_numpy()
    order = np.unique(names, return_index=True)[1]  # a class that several rows have counts once
    hashes = table.column("hashes")
    sets = [np.frombuffer(hashes[i].as_buffer(), np.uint64) for i in order.tolist()]
    names = names[order]
    across = table.column("low")[0].as_py() != table.column("high")[0].as_py()
    found = linked(sets, percent, 100, table.column("side").to_numpy()[order] if across else None)
    return pa.table({"a": pa.array([names[i] for i, _ in found], pa.int64()), "b": pa.array([names[j] for _, j in found], pa.int64())})
