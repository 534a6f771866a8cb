"""Collocations: phrases of two or three words that stand together more often than their parts.

Counts are exact and per language. Words counted at least ``least`` times get ids; no other word can
be part of a phrase that often, so n-grams end at the others. Every task counts n-grams
of ids in counting quotient filters and sends them by shard; the sorted filters of a shard are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.frames import row_keys
from millrace.llm.quotient_filter import Filter, Packing
from millrace.operators.prefix import HASH_KEY, running_offset
from millrace.session import stage

LONGEST = 3
# Words whose ids go to every task; ids of other words come with the texts that have them.
HEAD_WORDS = 1 << 16
RARE_ROWS = 1 << 16
COUNTER_WORDS = 1 << 19
FILTER_NGRAMS = 3 << 20
SHARD_NGRAMS = 1 << 21
SALTS = 64
_BREAK = b"."
_TABLE = bytearray(range(256))
_TABLE[65:91] = range(97, 123)
_TABLE[9] = 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = _BREAK[0]
_TABLE = bytes(_TABLE)
_EXACT = "decimal(13,0)"


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, percent: int = 50, head_words: int = HEAD_WORDS) -> DataFrame:
    """The ``top`` phrases per language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased in A-Z and cut at ``. , ; : ! ?`` and line ends into pieces, these at blanks and
    tabs into words. ``a`` counts a phrase of two or three words, ``l`` and ``r`` the parts of the cut with the
    smallest floor(1000000 * a * a / (l * r)), the first such cut; ``n`` counts all words of the
    language. A phrase inside a longer one that has ``percent`` of its count or more is left out.

    A null or empty text has no words; a null ``lang`` is ``und``. Every row counts, also repeated
    ones and those with null ids; texts may be of any length. Ties of score go to the larger
    ``a``, then to the smaller phrase in byte order. Other columns are ignored, and an empty table
    gives none. Ids of at most ``head_words`` words are sent to all tasks.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = stage(
        texts.mapInArrow(_counted, "lang string, word string, c bigint").groupBy("lang", "word").agg(F.sum("c").alias("c"))
        .where((F.col("c") >= least) | (F.col("word") == "")), "word-counts",
    )
    totals = counts.where("word = ''").select("lang", F.col("c").alias("n"))
    hashed = counts.where("word != ''").withColumn("h", F.shiftrightunsigned(F.xxhash64("lang", "word"), 4))
    placed = running_offset(hashed, "h", ties=["lang", "word"], out="place", shifts=HASH_KEY)
    vocabulary = stage(placed.select((F.col("place") + 1).alias("id"), "lang", "word", "c"), "phrase-words")
    grams = stage(ngram_counts(texts, vocabulary, totals, least, head_words), "phrase-counts")
    return _ranked(grams, vocabulary, totals, top, percent)


def ngram_counts(texts: DataFrame, vocabulary: DataFrame, totals: DataFrame, least: int, head_words: int = HEAD_WORDS) -> DataFrame:
    """(i, j, k, a): ids of two or three words in a row and their count, at least ``least``; ``k`` is 0 for two."""
    context = texts.sparkSession.sparkContext
    words = vocabulary.agg(F.count("*")).first()[0]
    tokens = totals.agg(F.sum("n")).first()[0] or 0
    shard_bits = max(4, (-(-(LONGEST - 1) * tokens // SHARD_NGRAMS)).bit_length())
    packing = Packing(max(words.bit_length(), 1), shard_bits)
    top = vocabulary.orderBy(F.desc("c"), "id").limit(head_words).collect()
    head: dict[str, dict[bytes, int]] = {}
    for row in top:
        head.setdefault(row["lang"], {})[row["word"].encode()] = row["id"]
    if words > len(top):
        last = top[-1]
        tail = vocabulary.where((F.col("c") < last["c"]) | ((F.col("c") == last["c"]) & (F.col("id") > last["id"])))
        texts = _with_own_words(texts, tail, context.broadcast({x: set(own) for x, own in head.items()}))
    else:
        texts = texts.withColumn("own", F.lit(None).cast("array<struct<word:string,id:bigint>>"))
    known = context.broadcast(head)
    filters = texts.mapInArrow(lambda batches: _filters(batches, known.value, packing), "shard bigint, entries binary")
    return filters.groupBy("shard").applyInArrow(lambda table: _merged(table, packing, least), "i bigint, j bigint, k bigint, a bigint")


def tokens_of(texts: list[bytes]) -> list[bytes]:
    """Lower-cased words of whole texts in order, with a full stop between pieces and between texts."""
    return b".".join(texts).translate(_TABLE).replace(_BREAK, b" . ").split()


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    langs = batch.column("lang")
    for lang in langs.unique().to_pylist():
        yield lang, batch.filter(pa.compute.equal(langs, lang))


def _parts(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in runs of whole texts of about ``most`` bytes."""
    sizes = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(size)
    if at < len(sizes):
        yield batch.slice(at)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, word, c) for lang, counter in counters.items() for word, c in counter.items()]
        counters.clear()
        langs, words, counts = zip(*rows)
        return pa.record_batch(
            [pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
            names=["lang", "word", "c"],
        )

    for batch in batches:
        for lang, own in _by_lang(batch):
            counter = counters.setdefault(lang, Counter())
            for part in _parts(own):
                found = tokens_of(part.column("text").cast(pa.binary()).to_pylist())
                stops = found.count(_BREAK)
                counter.update(found)
                del counter[_BREAK]
                counter[b""] += len(found) - stops  # all words of the language; no word is empty
        if sum(map(len, counters.values())) > COUNTER_WORDS:
            yield out()
    if counters:
        yield out()


def _with_own_words(texts: DataFrame, tail: DataFrame, head) -> DataFrame:
    """Adds ``own``: words of the text that have ids but are not known to all tasks, as (word, id)."""
    keyed = texts.withColumns(dict(zip(("k1", "k2"), row_keys("lang", "text"))))
    rare = keyed.mapInArrow(lambda batches: _rare(batches, head.value), "k1 bigint, k2 bigint, lang string, word string")
    own = rare.join(tail, ["lang", "word"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("word", "id")).alias("own"))
    return keyed.join(own, ["k1", "k2"], "left").select("lang", "text", "own")


def _rare(batches: Iterator[pa.RecordBatch], head: dict[str, set]) -> Iterator[pa.RecordBatch]:
    """A row for each different word of a text that is not in ``head``."""
    rows: list[tuple[int, int, str, int]] = []
    words: list[bytes] = []

    def out() -> pa.RecordBatch:
        k1, k2, langs, times = zip(*rows)
        times = np.array(times)
        columns = [pa.array(np.repeat(np.array(k, np.int64), times)) for k in (k1, k2)]
        lang = pa.array(langs, pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), times)))
        batch = pa.record_batch([*columns, lang, pa.array(words, pa.binary()).cast(pa.string())], names=["k1", "k2", "lang", "word"])
        rows.clear()
        words.clear()
        return batch

    for batch in batches:
        keys = [batch.column(name).to_pylist() for name in ("k1", "k2", "lang")]
        for k1, k2, lang, text in zip(*keys, batch.column("text").cast(pa.binary())):
            own = set(tokens_of([text.as_py()]))
            own -= head.get(lang, set())
            own.discard(_BREAK)
            rows.append((k1, k2, lang, len(own)))
            words.extend(own)
            if len(words) >= RARE_ROWS:
                yield out()
    if words:
        yield out()


def _filters(batches: Iterator[pa.RecordBatch], head: dict[str, dict[bytes, int]], packing: Packing) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        full = Filter.of(packing, *(np.concatenate(x) for x in zip(*held)))
        held.clear()
        rows = [(shard, part.to_bytes()) for shard, part in full.shards()]
        return pa.record_batch([pa.array([s for s, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["shard", "entries"])

    for batch in batches:
        for lang, rows in _by_lang(batch):
            for part in _parts(rows):
                ids = _ids(part, head.get(lang, {}))
                for i, j, k in _ngrams(ids):
                    if len(i):
                        held.append(packing.pack(i, j, k))
                        size += len(i)
                if size >= FILTER_NGRAMS:
                    yield out()
                    size = 0
    if held:
        yield out()


def _ids(part: pa.RecordBatch, head: dict[bytes, int]) -> np.ndarray:
    """Word ids of all texts in a row, zero between pieces and for words without an id."""
    own = {w["word"].encode(): w["id"] for words in part.column("own").to_pylist() if words for w in words}
    found = tokens_of(part.column("text").cast(pa.binary()).to_pylist())
    ids = np.array([head.get(w, 0) for w in found], np.int64)
    if own:
        missing = np.flatnonzero(ids == 0)
        ids[missing] = [own.get(found[i], 0) for i in missing.tolist()]
    return ids


def _ngrams(ids: np.ndarray):
    pair = (ids[:-1] > 0) & (ids[1:] > 0)
    at = np.flatnonzero(pair)
    yield ids[at], ids[at + 1], np.zeros(len(at), np.int64)
    at = np.flatnonzero(pair[:-1] & pair[1:])
    yield ids[at], ids[at + 1], ids[at + 2]


def _merged(table: pa.Table, packing: Packing, least: int) -> pa.Table:
    full = Filter.merge(packing, [Filter.from_bytes(entries.as_py()) for entries in table.column("entries")])
    return pa.table(dict(zip("ijka", map(pa.array, full.ngrams(least)))))


def _score(a: Column, left: Column, right: Column) -> DataFrame:
    """floor(1000000 * a * a / (l * r)) without rounding; ``a`` is never above ``l`` or ``r``."""
    exact = [x.cast(_EXACT) for x in (a, a, left, right)]
    return F.call_function("div", exact[0] * exact[1] * F.lit(1_000_000).cast("decimal(7,0)"), exact[2] * exact[3])


def _ranked(grams: DataFrame, vocabulary: DataFrame, totals: DataFrame, top: int, percent: int) -> DataFrame:
    pairs = grams.where("k = 0").select("i", "j", "a")
    triples = grams.where("k > 0")
    single = vocabulary.select("id", "c", "word", "lang")

    def word(name: str, *wanted: str) -> DataFrame:
        return single.select(F.col("id").alias(name), *[F.col(w).alias(f"{w}_{name}") for w in wanted])

    front = pairs.select("i", "j", F.col("a").alias("ij"))
    back = pairs.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("a").alias("jk"))
    triples = triples.join(front, ["i", "j"]).join(back, ["j", "k"])
    inside = triples.select(F.explode(F.array(F.struct("i", "j", "a"), F.struct(F.col("j").alias("i"), F.col("k").alias("j"), "a"))).alias("e"))
    longer = inside.select("e.*").groupBy("i", "j").agg(F.max("a").alias("longest"))
    pairs = pairs.join(longer, ["i", "j"], "left").where(f"longest is null or 100 * longest < {percent} * a")
    two = pairs.withColumn("k", F.lit(0).cast("bigint")).withColumns({"ij": F.lit(None).cast("bigint"), "jk": F.lit(None).cast("bigint")})
    shape = ["i", "j", "k", "a", "ij", "jk"]
    every = two.select(shape).unionByName(triples.select(shape))
    every = every.join(word("i", "c", "word", "lang"), "i").join(word("j", "c", "word"), "j").join(word("k", "c", "word"), "k", "left")
    a = F.col("a")
    cuts = F.when(F.col("k") == 0, F.array(_cut(a, F.col("c_i"), F.col("c_j"), 1))).otherwise(
        F.array(_cut(a, F.col("c_i"), F.col("jk"), 1), _cut(a, F.col("ij"), F.col("c_k"), 2))
    )
    scored = every.withColumn("cut", F.array_min(cuts)).select(
        F.col("lang_i").alias("lang"), F.concat_ws(" ", "word_i", "word_j", "word_k").alias("phrase"), "a", "cut.l", "cut.r", "cut.score"
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    firsts = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cut(a: Column, left: Column, right: Column, k: int) -> Column:
    return F.struct(_score(a, left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
