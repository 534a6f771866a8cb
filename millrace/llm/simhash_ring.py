"""Near-duplicate documents by SimHash fingerprints, candidates pruned on a ring of segments.

The 64 bits are eight segments on a ring. If two fingerprints differ in at most ``radius`` bits, the
differences cannot lie above their share everywhere: from some segment on, every chain of ``l``
consecutive ones holds at most ``l * radius / 8`` of them. So a pair is only looked at where such a
chain can begin: its first segments are the same, and of the next ones, which may differ in one bit,
either half is. Along the rest of the chain a pair must stay in its budget before all bits count.

Equal fingerprints are one class. Classes with the same key form a bucket; what is returned of it
is a star per component, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.components import star_forest
from millrace.llm.frames import bounded
from millrace.llm.words import slices
from millrace.session import stage

SEGMENTS, BITS = 8, 8
SEED = 42
STEP = 1 << 16
# Classes of a bucket that one task compares; a larger bucket is cut into sides, and two sides meet in a task.
TILE = 4096
# Buckets that may be broadcast as larger than a tile.
BROADCAST_ROWS = 1 << 18
# Buckets up to this size are compared by shifting the rows of a batch against themselves.
FEW = 8


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint bigint) of every row: the SimHash of its repeated ``size``-word shingles.

    A bit is one if more than half of the shingles' XXH64 values have it. A text of fewer words is
    one shingle; a text without words, empty or null, has the fingerprint zero.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _fingerprints(batches, size), "doc_id bigint, fingerprint bigint")


def near_groups(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents that links of at most ``radius`` bits connect.

    ``component_id`` is the smallest ``doc_id`` that can be reached. Every fingerprint links like any other, also
    zero, which empty, blank and null texts have. Rows that repeat an id or a text are kept each; a row with
    a null id has the component of its group, or null if the group has no other id. Other columns
    are ignored; an empty table gives none. ``radius`` is below the number of segments.
    """
    if not 0 <= radius < SEGMENTS:
        raise ValueError(f"radius must be 0 to {SEGMENTS - 1}")
    marked = stage(fingerprints(docs, size), "fingerprints")
    classes = stage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "fingerprint-classes")
    forest = star_forest(stage(links(classes.select("fingerprint"), radius), "fingerprint-links"))
    roots = forest.unionByName(forest.select(F.col("root").alias("node"), "root").distinct())
    named = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    least = named.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = named.join(least, "root", "left").select("fingerprint", F.coalesce("least_id", "first_id").alias("component_id"))
    return marked.join(named, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def budgets(radius: int) -> list[int]:
    """Most differing bits in the first l segments of a chain, for l = 1 to all."""
    return [(l + 1) * radius // SEGMENTS for l in range(SEGMENTS)]


def turned(fingerprint: Column, start: int) -> Column:
    """The fingerprint with segment ``start`` in its lowest bits."""
    by = start * BITS
    return fingerprint if by == 0 else F.shiftrightunsigned(fingerprint, by).bitwiseOR(F.shiftleft(fingerprint, 64 - by))


def bucket_keys(fingerprint: Column, radius: int) -> Column:
    """Array of (slot, bits): for each start its equal segments with either half of those that may differ in a bit."""
    limits = budgets(radius)
    same = BITS * limits.count(0)
    loose = BITS * limits.count(1)
    cuts = [(0, loose // 2), (loose // 2, loose - loose // 2)] if loose else [(0, 0)]
    keys = []
    for start in range(SEGMENTS if radius else 1):
        chain = turned(fingerprint, start)
        for half, (at, wide) in enumerate(cuts):
            mask = ((1 << same) - 1 if same < 64 else -1) | (((1 << wide) - 1) << (same + at) if wide else 0)
            mask -= 1 << 64 if mask >= 1 << 63 else 0
            keys.append(F.struct(F.lit(2 * start + half).cast("tinyint").alias("slot"), chain.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``radius``, enough to connect every component."""
    rows = classes.select("fingerprint", F.explode(bucket_keys(F.col("fingerprint"), radius)).alias("k")).select("k.slot", "k.bits", "fingerprint")
    large = stage(rows.groupBy("slot", "bits").agg(F.count("*").alias("members")).where(F.col("members") > TILE), "large-buckets")
    sides = F.ceil(F.coalesce("members", F.lit(1)) / F.lit(TILE // 2)).cast("int")
    dealt = rows.join(bounded(large, BROADCAST_ROWS), ["slot", "bits"], "left").withColumn("sides", sides)
    side = F.pmod(F.xxhash64("fingerprint"), F.col("sides")).cast("int")
    tiles = F.when(F.col("sides") <= 2, F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("sides") - 1),
            lambda other: F.struct(F.least(other, side).alias("low"), F.greatest(other, side).alias("high")),
        )
    )
    dealt = dealt.withColumn("t", F.explode(tiles)).select("slot", "bits", F.col("t.low").alias("low"), F.col("t.high").alias("high"), "fingerprint")
    keys = ["slot", "bits", "low", "high"]
    runs = dealt.repartition(*keys).sortWithinPartitions(*keys, "fingerprint")
    return runs.mapInArrow(lambda batches: _buckets(batches, radius), "a bigint, b bigint").distinct()


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows, np.uint64)
        for first, raw, offsets in slices(batch.column("text")):
            for i in range(len(offsets) - 1):
                out[first + i] = simhash(raw[offsets[i] : offsets[i + 1]].tobytes(), size)
        yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(out.view(np.int64))], names=["doc_id", "fingerprint"])


def simhash(text: bytes, size: int) -> int:
    words = text.lower().split()  # of bytes: only A-Z is lowered, and words end at x20 and x09-x0D
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    take = min(size, len(words))
    joined = b" ".join(words)
    begins, ends = begins[: len(words) - take + 1], ends[take - 1 :]
    set_bits = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(ends), STEP):
        spans = zip(begins[at : at + STEP].tolist(), ends[at : at + STEP].tolist())
        values = np.array([hashed(joined[a:b], SEED) for a, b in spans], "<u8")
        set_bits += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(ends), bitorder="little").view("<u8")[0])


def _buckets(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of every bucket in sorted rows; the last bucket of a batch waits for the next batch."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        if not len(columns[0]):
            continue
        heads = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:4]])))
        held = [c[heads[-1] :] for c in columns]
        yield from _linked(columns, heads, radius, heads[-1])
    if held is not None and len(held[0]):
        yield from _linked(held, np.zeros(1, np.int64), radius, len(held[0]))


def _linked(columns: list[np.ndarray], heads: np.ndarray, radius: int, end: int) -> Iterator[pa.RecordBatch]:
    """Links of the buckets that begin at ``heads`` and lie before ``end``."""
    heads = heads[heads < end]
    if not len(heads):
        return
    sizes = np.diff(np.append(heads, end))
    names = columns[4][:end]
    bucket = np.repeat(np.arange(len(heads)), sizes)
    by = (columns[0][:end].astype(np.uint64) >> np.uint64(1)) * np.uint64(BITS)
    plain = names.view(np.uint64)
    chains = (plain >> by) | (plain << ((np.uint64(64) - by) & np.uint64(63)))  # shifts by 0 and 64 both leave it as it is
    left, right = [], []
    few = (sizes <= FEW)[bucket]
    for shift in range(1, min(FEW, int(sizes.max()))):
        i = np.flatnonzero(few[shift:] & (bucket[shift:] == bucket[:-shift]))
        good = within(chains[i] ^ chains[i + shift], radius)
        left.append(names[i[good]])
        right.append(names[i[good] + shift])
    for b in np.flatnonzero(sizes > FEW):
        span = slice(heads[b], heads[b] + sizes[b])
        for star in stars(chains[span], radius):
            own = names[span][star]
            left.append(np.full(len(own) - 1, own[0]))
            right.append(own[1:])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    if len(a):
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def within(differing: np.ndarray, radius: int) -> np.ndarray:
    """Places where every chain from the lowest segment on keeps its budget; the whole ring is the last chain."""
    place = np.arange(len(differing))
    for segments, limit in enumerate(budgets(radius), 1):
        mask = np.uint64((1 << segments * BITS) - 1)
        keep = np.bitwise_count(differing & mask) <= limit
        place, differing = place[keep], differing[keep]
    return place


def stars(chains: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Components of more than one member: each member found meets only those not reached yet."""
    rest = np.arange(len(chains))
    while len(rest):
        found, waiting = [rest[0]], [rest[0]]
        rest = rest[1:]
        while waiting and len(rest):
            hit = within(chains[rest] ^ chains[waiting.pop()], radius)
            if len(hit):
                fresh = rest[hit]
                found.extend(fresh.tolist())
                waiting.extend(fresh.tolist())
                rest = np.delete(rest, hit)
        if len(found) > 1:
            yield np.array(found)
