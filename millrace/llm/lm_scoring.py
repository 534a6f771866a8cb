"""Document log-likelihoods under word counts and under a gated recurrent model of the corpus.

Tokens are words and one end per document. All counts are taken from all training documents;
words are known by a 64-bit hash. The most frequent words' counts go to every task; how often
rarer words occur is joined to the documents that have them, so no count is cut off. Texts are read
twice, to be counted and to be turned into numbers of words, which are kept; training and scoring read
those. The recurrent weights start from a bounded sample and are then fitted on every partition to all of its training
documents, and averaged, weighted by tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm import gru_lm
from millrace.llm.words import Words, slices
from millrace.session import stage

# Bound: words whose counts go to every task.
HEAD_WORDS = 1 << 16
# Words with weights of their own: so many at least, and so many times the root of the distinct words.
MODEL_WORDS = 2500
ROOT_WORDS = 8
# The sample that weights start from; all training documents refine them.
START_DOCS = 1500
# Documents side by side when all training documents refine the weights.
LANES = 512
# Weights in a row when partitions are averaged.
SLOT = 1 << 14
SHAPES = 30
END = np.uint64(0)
COLLECT = 1 << 19
# Tokens that are scored at once, in whole documents.
SCORED = 1 << 21


def shape_of(raw: np.ndarray, words: Words) -> np.ndarray:
    """Class of a word by its last byte's kind, bytes beyond ASCII and length."""
    if not len(words.starts):
        return np.zeros(0, np.int64)
    last = raw[words.ends - 1]
    letter = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128)
    kind = np.select([letter, last == 46, last == 44, (last >= 48) & (last <= 57)], [0, 1, 2, 3], 4)
    wide = np.zeros(len(words.starts), bool)
    beyond = np.flatnonzero(raw >= 128)
    wide[np.searchsorted(words.starts, beyond, "right") - 1] = True
    size = words.ends - words.starts
    return kind * 6 + wide * 3 + (size > 4) + (size > 8)


def token_runs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, shape, bounds) of the tokens of runs of whole texts, each text closed by an end."""
    for _, raw, offsets in slices(texts):
        words = Words.of(raw, offsets)
        n = len(offsets) - 1
        at = words.bounds[1:]
        hashes = np.insert(np.where(words.hashes == END, np.uint64(1), words.hashes), at, END)
        shapes = np.insert(shape_of(raw, words), at, 0)
        yield hashes, shapes, words.bounds + np.arange(n + 1)


# --- counts ----------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, k, n = (np.concatenate(x) for x in zip(*held))
        return counted(h, k, n)

    def counted(h, k, n=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        coded = pa.array(h.view(np.int64)).dictionary_encode()
        number = coded.indices.to_numpy()
        values = coded.dictionary.to_numpy().view(np.uint64)
        shapes = np.zeros(len(values), np.int64)
        shapes[number[::-1]] = k[::-1]  # the first stays
        return values, shapes, np.bincount(number, n, len(values)).astype(np.int64)

    def out(h, k, n):
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(k, pa.int32()), pa.array(n)], names=["h", "k", "n"])

    for batch in batches:
        for hashes, shapes, _ in token_runs(batch.column("text")):
            held.append(counted(hashes, shapes))
            if sum(len(x[0]) for x in held) > COLLECT:
                held = [merged()]
                if len(held[0][0]) > COLLECT // 2:
                    yield out(*held[0])
                    held = []
    if held:
        yield out(*merged())


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, k, c): hash, shape and count of every token of whole texts; the end has hash 0."""
    return docs.select("text").mapInArrow(_counted, "h bigint, k int, n bigint").groupBy("h").agg(
        F.min("k").alias("k"), F.sum("n").alias("c")
    )


@dataclass
class Counts:
    """What every task gets: totals, frequent words by hash, totals of the shape classes."""

    tokens: int
    distinct: int
    hashes: np.ndarray  # sorted
    counts: np.ndarray
    model_ids: np.ndarray  # -1 for a word without weights of its own
    shape_size: np.ndarray  # occurrences + distinct + 1 of the rest of each shape
    layout: gru_lm.Layout
    class_counts: np.ndarray
    word_counts: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame) -> Counts:
        total = counts.agg(F.sum("c").alias("tokens"), F.count("*").alias("distinct")).first()
        top = counts.orderBy(F.desc(F.col("h") == 0), F.desc("c"), "h").limit(HEAD_WORDS).collect()
        h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
        c = np.array([r["c"] for r in top], np.int64)
        words = min(max(MODEL_WORDS, ROOT_WORDS * math.isqrt(total["distinct"])), len(top))
        used = np.zeros((SHAPES, 2))
        for r in top[:words]:
            used[r["k"]] += (r["c"], 1)
        shapes = np.zeros((SHAPES, 2))
        for r in counts.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
            shapes[r["k"]] = (r["c"], r["n"])
        rest = shapes - used
        layout = gru_lm.Layout(words, SHAPES, c[:words], rest[:, 0])
        blocks = np.add.reduceat(c[:words], layout.cuts[:-1]) if words else np.zeros(0)
        order = np.argsort(h)
        ids = np.where(np.arange(len(h)) < words, np.arange(len(h)), -1)
        return cls(
            int(total["tokens"] or 0), int(total["distinct"]), h[order], c[order], ids[order], rest.sum(axis=1) + 1, layout,
            np.concatenate((blocks, rest[:, 0])), c[:words],
        )

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1, model id or -1) of each token."""
        at = pc.index_in(pa.array(hashes.view(np.int64)), value_set=pa.array(self.hashes.view(np.int64)))
        at = pc.fill_null(at, len(self.hashes)).to_numpy()
        return np.append(self.counts, -1)[at], np.append(self.model_ids, -1)[at]


# --- numbers of words ------------------------------------------------------------------


def encode(docs: DataFrame, training: Column, counts: Counts) -> DataFrame:
    """A row per document: its sums that need no model, the words that are not among the frequent ones, and all tokens' numbers.

    (doc_id, trained, row, n_tokens, n_known, base, inside, rare, ids); ids are 32-bit numbers in bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        of_shapes = np.log10(held.shape_size)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            for hashes, shapes, bounds in token_runs(batch.column("text")):
                n = len(bounds) - 1
                c, ids = held.look_up(hashes)
                owner = np.repeat(np.arange(n), np.diff(bounds))
                logs = np.log10(np.maximum(c, 0) + 1.0)
                inside = np.where(ids < 0, logs - of_shapes[shapes], 0.0)
                rare = np.concatenate(([0], np.cumsum(c < 0)))[bounds]
                tokens = np.where(ids >= 0, ids, held.layout.words + shapes).astype(np.int32)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(at, n), batch.column("trained").slice(at, n), pa.array(row + np.arange(n)),
                     pa.array(np.diff(bounds)), pa.array(np.bincount(owner[c > 0], minlength=n)),
                     pa.array(np.bincount(owner, logs, n)), pa.array(np.bincount(owner, inside, n)),
                     pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(hashes[c < 0].view(np.int64))),
                     pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(tokens)])],
                    names=["doc_id", "trained", "row", "n_tokens", "n_known", "base", "inside", "rare", "ids"],
                )
                at, row = at + n, row + n

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("trained"), "text").mapInArrow(
        encoded,
        "doc_id bigint, trained boolean, row bigint, n_tokens bigint, n_known bigint, base double, inside double, rare array<bigint>, ids binary",
    )


def _documents(ids: pa.Array) -> list[np.ndarray]:
    """Numbers of the words of every document."""
    offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] // 4
    tokens = np.frombuffer(ids.buffers()[2] or b"", np.int32, count=int(offsets[-1]) if len(offsets) else 0)
    return [tokens[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


# --- weights ---------------------------------------------------------------------------


def fit(docs: DataFrame, counts: Counts) -> np.ndarray:
    """Weights of the recurrent model, as one flat array."""
    return refine(stage(encode(docs, F.lit(True), counts), "training-words"), counts)


def refine(encoded: DataFrame, counts: Counts) -> np.ndarray:
    """Weights from the documents of ``encode``."""
    spark = encoded.sparkSession
    chosen = encoded.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(START_DOCS)
    sample = encoded.select("doc_id", "ids").join(F.broadcast(chosen), "doc_id")
    rows = sorted((i, bytes(ids)) for i, ids in sample.collect())[:START_DOCS]
    start = gru_lm.start_weights(counts.layout, counts.class_counts, counts.word_counts)
    gru_lm.Trainer(start, counts.layout).fit([np.frombuffer(ids, np.int32) for _, ids in rows], passes=2)
    layout = spark.sparkContext.broadcast(counts.layout)
    begun = spark.sparkContext.broadcast(gru_lm.flatten(start))

    def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = gru_lm.Trainer(gru_lm.unflatten(begun.value, layout.value), layout.value, rate=0.006)
        seen = 0
        for batch in batches:
            seen += trainer.fit(_documents(batch.column("ids")), lanes=LANES)
        if seen:
            flat = gru_lm.flatten(trainer.w)
            parts = [flat[at : at + SLOT].tobytes() for at in range(0, len(flat), SLOT)]
            yield pa.record_batch(
                [pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())],
                names=["slot", "seen", "part"],
            )

    means = (
        encoded.select("ids").mapInArrow(refined, "slot int, seen bigint, part binary")
        .groupBy("slot").applyInArrow(_mean, "slot int, part binary").collect()  # a row per SLOT weights
    )
    if not means:
        return begun.value
    return np.concatenate([np.frombuffer(part, np.float32) for _, part in sorted(map(tuple, means))])


def _mean(rows: pa.Table) -> pa.Table:
    """Mean of the weights of one slot, weighted by tokens."""
    seen = rows.column("seen").to_pylist()
    total = sum(n * np.frombuffer(part.as_py(), np.float32).astype(np.float64) for n, part in zip(seen, rows.column("part")))
    mean = (total / sum(seen)).astype(np.float32).tobytes()
    return pa.table({"slot": rows.column("slot").slice(0, 1), "part": pa.array([mean], pa.binary())})


# --- scores ----------------------------------------------------------------------------


def score(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, trained): a row per document.

    ``training`` says which rows are learned from. Both scores are log10-probabilities of a whole
    text with its end; ``base_score`` adds log10((c + 1) / (N + V + 1)) of the tokens' counts.
    A null text is empty: one end. Rows that repeat an id are scored each; null ids stay.
    Without training text the counts are 0 and both scores are equal. Other columns are ignored.
    """
    spark = docs.sparkSession
    learned = docs.where(training)
    table = stage(word_counts(learned), "word-counts")
    counts = Counts.of(table)
    kept = stage(encode(docs, training, counts), "document-words")
    scored = kept.drop("rare", "ids").withColumn("model", F.lit(0.0))
    if counts.tokens:
        layout, flat = (spark.sparkContext.broadcast(x) for x in (counts.layout, refine(kept.where("trained"), counts)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = gru_lm.unflatten(flat.value, layout.value)
            for batch in batches:
                documents = _documents(batch.column("ids"))
                ends = np.cumsum([len(d) for d in documents])
                logs, at = [], 0
                while at < len(documents):
                    stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SCORED, "right")))
                    logs.append(gru_lm.score_documents(model, layout.value, documents[at:stop]))
                    at = stop
                if logs:
                    yield batch.drop_columns(["ids"]).append_column("model", pa.array(np.concatenate(logs)))

        scored = kept.drop("rare").mapInArrow(
            run, "doc_id bigint, trained boolean, row bigint, n_tokens bigint, n_known bigint, base double, inside double, model double"
        )
    # no word here is frequent, so rows of one are few, and neither side has to be sorted
    rare = kept.select("row", F.explode("rare").alias("h"))
    found = rare.join(table.select("h", "c").hint("shuffle_hash"), "h").groupBy("row").agg(
        F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("logs"), F.count("*").alias("known")
    )
    space = float(np.log10(counts.tokens + counts.distinct + 1))
    logs = F.coalesce("logs", F.lit(0.0))
    base = F.col("base") + logs - F.col("n_tokens") * F.lit(space)
    return scored.join(found, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"),
        (F.col("model") + F.col("inside") + logs if counts.tokens else base).alias("score"), "trained",
    )
