"""Documents that contain benchmark items, found by SimHash of item-sized windows.

DataFrame functions only. A window has as many words as an item; its fingerprint is the SimHash
of its word shingles, each counted as often as it occurs. Fingerprints of items are indexed by
blocks of 7 bits: 9 blocks of which one differs in at most a ninth of the radius whenever all 63 differ
in at most the radius. Every value within that distance of an item's block is in the index, so
windows look theirs up by equality, and what is found is within the radius or dropped. The
shared weight of shingles then verifies each candidate exactly.

The radius follows from the similarity: so many bits differ by chance, and five deviations more.
That holds for items of many different shingles. Of an item in which a few make up most of the weight,
as in words that repeat, one change can turn every bit: such items skip the fingerprints, and
all windows of their length that share a shingle are verified.

A window as similar as wanted shares a shingle with the item, so only windows with a shingle of
an item of their length are fingerprinted; that leaves out no match.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.frames import bounded, free_names, row_keys
from millrace.session import stage

SHINGLE = 5
PERCENT = 80
BLOCKS, BLOCK_BITS = 9, 7
DEVIATIONS = 5
# Items of fewer shingles of equal weight, by the same sum of squares, are verified without fingerprints.
FEW_SHINGLES = 8
BROADCAST_ROWS = 1 << 20


def word_array(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def gram_hashes(words: Column, size: int) -> Column:
    """Hash of each run of ``size`` words; an empty array if there are fewer."""
    run = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)])
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), run)).otherwise(
        F.array().cast("array<bigint>")
    )


def simhash(grams: Column, most: int) -> Column:
    """63-bit majority vote over the bits of the hashes in an array of up to ``most``.

    Bits are counted in fields of a long: ``width`` sums hold 63 // width counters each.
    """
    width = 9 if most < 256 else 21
    ones = sum(1 << (k * width) for k in range(63 // width))
    over = F.lit((1 << (width - 1)) - 1) - F.floor(F.size(grams) / 2).cast("bigint")
    add = lambda j: lambda total, h: total + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(ones))
    bits = None
    for j in range(width):
        count = F.aggregate(grams, F.lit(0).cast("bigint"), add(j))
        vote = (count + over * F.lit(ones)).bitwiseAND(F.lit(ones << (width - 1)))
        vote = F.shiftrightunsigned(vote, j)
        bits = vote if bits is None else bits.bitwiseOR(vote)
    return bits


def block(bits: Column, number) -> Column:
    """A block of 7 bits of a fingerprint."""
    return F.call_function("shiftrightunsigned", bits, number * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def radius_of(percent: int) -> int:
    """Bits in which fingerprints of that similarity differ at most: the mean and some deviations.

    At similarity s the vectors of counts have a cosine of about 2s / (1 + s); a bit differs as often as
    a plane drawn by chance parts the two.
    """
    bits = BLOCKS * BLOCK_BITS
    share = math.acos(min(2 * percent / (100 + percent), 1)) / math.pi
    return min(math.ceil(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share))), bits)


def near_masks(radius: int) -> list[int]:
    """Every difference of a block in up to ``radius // BLOCKS`` bits."""
    return [
        sum(1 << b for b in bits) for n in range(radius // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)
    ]


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_words, gram, grams, few, bits) of every item with a word; ``few`` if few shingles have most of the weight."""
    words = benchmark.select("item_id", word_array(F.col("text")).alias("w")).where("size(w) > 0")
    sized = words.withColumns({"n_words": F.size("w"), "gram": F.least(F.lit(SHINGLE), F.size("w"))})
    grams = F.coalesce(*[F.when(F.col("gram") == g, gram_hashes(F.col("w"), g)) for g in range(1, SHINGLE + 1)])
    squares = F.aggregate("grams", F.lit(0), lambda total, h: total + F.size(F.filter("grams", lambda x: x == h)))
    few = F.size("grams") * F.size("grams") < FEW_SHINGLES * squares
    sized = sized.select("item_id", "n_words", "gram", grams.alias("grams"))
    items = stage(sized.withColumn("few", few), "benchmark-items")
    most = items.agg(F.max(F.size("grams"))).first()[0] or 0
    return items.withColumn("bits", simhash(F.col("grams"), most))


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(k1, k2, doc_id, item_id, similarity, start_word): a row per document and item found in it.

    Words are lower-case runs of letters and digits, shingles have five words; an item of fewer
    is one shingle of all its words, and an item without words, or null, is never found. The
    similarity of a window and an item is the sum of the smaller counts of their shingles over
    the sum of the larger; the best window of at least ``percent`` is reported, the first if
    several are. A document shorter than the item is one window of all its words. Null and empty texts
    contain nothing. Rows that repeat an id and text count
    once; equal items are each found. Other columns are ignored.
    """
    items = stage(items_of(benchmark), "benchmark-fingerprints")
    sizes = [r[0] for r in items.select("gram").distinct().collect()]  # at most SHINGLE numbers
    most = items.agg(F.max(F.size("grams"))).first()[0] or 0
    k1, k2 = row_keys()
    rows = docs.where(F.col("text").isNotNull()).select(k1.alias("k1"), k2.alias("k2"), "doc_id", "text")
    known = items.select("gram", "n_words", F.explode("grams").alias("h")).distinct()
    known = bounded(stage(known, "benchmark-shingles"), BROADCAST_ROWS)

    # where documents have a shingle of an item: (document, words of the item, places)
    found = None
    for gram in sizes or [SHINGLE]:
        places = (
            rows.select("k1", "k2", word_array(F.col("text")).alias("w"))
            .select("k1", "k2", F.posexplode(gram_hashes(F.col("w"), gram)).alias("place", "h"))
            .join(known.where(F.col("gram") == gram), "h").select("k1", "k2", "gram", "n_words", "place")
        )
        found = places if found is None else found.unionByName(places)
    hits = found.groupBy("k1", "k2", "gram", "n_words").agg(F.collect_set("place").alias("places"))
    hits = bounded(stage(hits, "benchmark-hits"), BROADCAST_ROWS, F.size("places") + 4)

    # the windows of that many words over those places, each with its shingles
    windows = None
    first = lambda p: F.greatest(F.lit(0), p - (F.col("n_words") - F.col("gram")))
    last = lambda p: F.greatest(F.lit(0), F.least(p, F.size("w") - F.col("n_words")))
    for gram in sizes or [SHINGLE]:
        near = rows.join(hits.where(F.col("gram") == gram), ["k1", "k2"]).dropDuplicates(["k1", "k2", "n_words"])
        near = near.withColumn("w", word_array(F.col("text")))
        starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.when(
            first(p) <= last(p), F.sequence(first(p), last(p))).otherwise(F.array().cast("array<int>")))))
        cut = near.select("k1", "k2", "doc_id", "n_words", "gram", gram_hashes(F.col("w"), gram).alias("all"), starts.alias("starts"))
        cut = cut.select("k1", "k2", "doc_id", "n_words", "gram", "all", F.explode("starts").alias("start"))
        part = cut.select(
            "k1", "k2", "doc_id", "n_words", "start", F.slice("all", F.col("start") + 1, F.col("n_words") - F.col("gram") + 1).alias("grams")
        )
        windows = part if windows is None else windows.unionByName(part)
    windows = windows.withColumn("bits", simhash(F.col("grams"), most))

    numbers = F.array(*[F.lit(b) for b in range(BLOCKS)])
    radius = radius_of(percent)
    masks = F.array(*[F.lit(m) for m in near_masks(radius)])
    index = items.where("not few").select("item_id", "n_words", F.col("bits").alias("item_bits"), F.explode(numbers).alias("block")).select(
        "item_id", "n_words", "item_bits", "block", F.explode(masks).alias("mask")
    )
    index = index.select("item_id", "n_words", "item_bits", "block", block(F.col("item_bits"), F.col("block")).bitwiseXOR(F.col("mask")).alias("value"))
    index = bounded(stage(index, "benchmark-index"), BROADCAST_ROWS)
    probes = windows.select("*", F.explode(numbers).alias("block")).withColumn("value", block(F.col("bits"), F.col("block")))
    differ = F.col("bits").bitwiseXOR(F.col("item_bits"))
    # a pair met in several blocks counts in the first of them
    reach = [F.when(F.bit_count(block(differ, F.lit(b))) <= radius // BLOCKS, F.lit(b)) for b in range(BLOCKS)]
    candidates = probes.join(index, ["n_words", "block", "value"]).where(
        (F.bit_count(differ) <= radius) & (F.coalesce(*reach) == F.col("block"))
    ).select("k1", "k2", "doc_id", "n_words", "start", "grams", "item_id")
    direct = bounded(items.where("few").select("item_id", "n_words", F.explode("grams").alias("h")).distinct(), BROADCAST_ROWS)
    lengths = F.broadcast(items.where("few").select("n_words").distinct())  # a row per length of an item
    shingles = windows.join(lengths, "n_words", "left_semi").select("k1", "k2", "doc_id", "n_words", "start", "grams", F.explode(F.array_distinct("grams")).alias("h"))
    sharing = shingles.join(direct, ["n_words", "h"]).drop("h").dropDuplicates(["k1", "k2", "n_words", "start", "item_id"])
    candidates = candidates.unionByName(sharing)
    wanted = bounded(items.select("item_id", "n_words", F.col("grams").alias("own")), BROADCAST_ROWS, F.size("own"))
    pairs = candidates.join(wanted, ["item_id", "n_words"])
    shared = F.aggregate(
        F.array_intersect("grams", "own"), F.lit(0),
        lambda total, h: total + F.least(F.size(F.filter("grams", lambda x: x == h)), F.size(F.filter("own", lambda x: x == h))),
    )
    judged = pairs.withColumn("shared", shared).withColumn("all", F.size("grams") + F.size("own") - F.col("shared"))
    good = judged.where(100 * F.col("shared") >= percent * F.col("all"))
    best = F.max(F.struct((F.col("shared") / F.col("all")).alias("similarity"), (-F.col("start")).alias("start")))
    return good.groupBy("k1", "k2", "doc_id", "item_id").agg(best.alias("best")).select(
        "k1", "k2", "doc_id", "item_id", "best.similarity", (-F.col("best.start")).cast("bigint").alias("start_word")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that contain an item of ``benchmark``; other rows stay as they are."""
    k1, k2 = free_names(docs.columns, "k1", "k2")
    bad = stage(contamination(docs, benchmark, percent).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct(), "contaminated")
    keyed = docs.withColumns(dict(zip((k1, k2), row_keys())))
    return keyed.join(bounded(bad, BROADCAST_ROWS), [k1, k2], "left_anti").select(*docs.columns)
