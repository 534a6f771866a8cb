"""Quality scores by attention over passages: multiple-instance learning with gated attention.

A document is a bag of passages of ``PASSAGE`` words. Every passage is described by its shares of
kinds of characters and by how its words repeat, encoded by one hidden layer, and given
an attention weight by a gated unit. The weighted mean of the encodings is scored. Only the
document has a label; what to attend to is learned from that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.words import Words, mix, slices

PASSAGE = 64
HIDDEN = 24
GATE = 12
# Bound of the sample that the model is fitted on.
TRAIN_DOCS = 6000

_KIND = np.full(256, 5, np.int64)  # bytes beyond ASCII
_KIND[:128] = 6  # control characters
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[32], _KIND[10] = 0, 1, 2, 3, 4
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_KIND[_MARKS] = 7 + np.arange(len(_MARKS))
KINDS = 7 + len(_MARKS)
FEATURES = KINDS + 8


def passages(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, first passage of each text and the end) for runs of whole texts.

    A text without words, empty or null, is one passage of zeros.
    """
    for _, raw, offsets in slices(texts):
        words = Words.of(raw, offsets)
        per_text = np.diff(words.bounds)
        count = np.maximum(1, -(-per_text // PASSAGE))
        bounds = np.concatenate(([0], np.cumsum(count)))
        x = np.zeros((bounds[-1], FEATURES), np.float32)
        text_of = np.repeat(np.arange(len(per_text)), per_text)
        within = np.arange(len(text_of)) - words.bounds[text_of]
        home = bounds[text_of] + within // PASSAGE
        n_words = np.bincount(home, minlength=len(x)).astype(np.float32)
        some = np.maximum(n_words, 1)
        if len(home):
            # a passage's bytes go from its first word to the next passage's, or the text's end
            first = np.flatnonzero(within % PASSAGE == 0)
            ends = np.concatenate((words.starts[first[1:]], [len(raw)]))
            last = np.concatenate((text_of[first][1:] != text_of[first][:-1], [True]))
            ends = np.where(last, offsets[text_of[first] + 1], ends)
            lengths = ends - words.starts[first]
            owner = np.repeat(home[first], lengths)
            steps = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = np.repeat(words.starts[first], lengths) + steps
            tally = np.bincount(owner * KINDS + _KIND[raw[at]], minlength=len(x) * KINDS).reshape(-1, KINDS)
            x[:, :KINDS] = np.sqrt(tally / np.maximum(tally.sum(axis=1, keepdims=True), 1))
            size = (words.ends - words.starts).astype(np.float32)
            salted = mix(words.hashes + text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            same = np.concatenate(([False], salted[1:] == salted[:-1]))
            new_word = _first_seen(salted)
            new_pair = _first_seen(salted + np.concatenate(([np.uint64(0)], salted[:-1])) * np.uint64(0xD6E8FEB86659FD93))
            capital = _KIND[raw[words.starts]] == 1
            shout = capital & (_KIND[raw[np.minimum(words.starts + 1, words.ends - 1)]] == 1)
            mean = lambda v: np.bincount(home, v, minlength=len(x)) / some
            x[:, KINDS] = np.log1p(n_words) / 4
            x[:, KINDS + 1] = mean(size) / 10
            x[:, KINDS + 2] = np.sqrt(np.maximum(mean(size**2) - mean(size) ** 2, 0)) / 10
            for k, v in enumerate((same, ~new_word, ~new_pair, capital, shout)):
                x[:, KINDS + 3 + k] = mean(v)
        yield x, bounds


def _first_seen(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs for the first time."""
    out = np.zeros(len(keys), dtype=bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


@dataclass
class AttentionModel:
    """Weights of encoder, gated attention and scorer; ``score`` gives one number per bag."""

    centre: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bounds: np.ndarray):
        w = self.weights
        x = np.clip((x - self.centre) / self.spread, -6, 6)
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        tan, sig = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (tan * sig) @ w["att"]
        bag = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        e = np.exp(e - np.maximum.reduceat(e, bounds[:-1])[bag])
        a = e / np.add.reduceat(e, bounds[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, bounds[:-1], axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out_b"], -30, 30)))
        return x, h, tan, sig, a, bag, z, p

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.forward(x, bounds)[-1].astype(np.float64)

    def gradients(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x, h, tan, sig, a, bag, z, p = self.forward(x, bounds)
        d = (p - y) / len(y)
        dz = d[:, None] * w["out"]
        da = (h * dz[bag]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, bounds[:-1])[bag])
        dg = de[:, None] * w["att"]
        dtan, dsig = dg * sig * (1 - tan**2), dg * tan * sig * (1 - sig)
        dh = a[:, None] * dz[bag] + dtan @ w["v"].T + dsig @ w["u"].T
        dx = dh * (1 - h**2)
        return {
            "enc": x.T @ dx, "enc_b": dx.sum(axis=0), "v": h.T @ dtan, "u": h.T @ dsig,
            "att": (tan * sig).T @ de, "out": z.T @ d, "out_b": d.sum(),
        }


def train(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, seed: int = 7) -> AttentionModel:
    """Adam on the log-loss of the bags' labels."""
    rng = np.random.default_rng(seed)
    init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    weights = {
        "enc": init(FEATURES, HIDDEN), "enc_b": np.zeros(HIDDEN, np.float32), "v": init(HIDDEN, GATE),
        "u": init(HIDDEN, GATE), "att": init(GATE), "out": init(HIDDEN), "out_b": np.float32(0),
    }
    model = AttentionModel(x.mean(axis=0), x.std(axis=0) + 0.02, weights)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            some = order[at : at + batch]
            rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in some])
            own = np.concatenate(([0], np.cumsum(bounds[some + 1] - bounds[some])))
            step += 1
            for k, g in model.gradients(x[rows], own, y[some]).items():
                g = g + 1e-4 * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_DOCS) -> AttentionModel | None:
    """A model from all passages of at most ``most`` labelled documents, evenly chosen by a hash of their id.

    Rows without an id or a label are left out; of repeated ids the smallest label counts.
    None if nothing is left.
    """
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(_sampled, "y double, x binary").collect()
    if not found:
        return None
    bags = [np.frombuffer(r["x"], np.float16).astype(np.float32).reshape(-1, FEATURES) for r in found[:most]]
    order = sorted(range(len(bags)), key=lambda i: (found[i]["y"], bags[i].tobytes()))  # whatever order rows came in
    bags = [bags[i] for i in order]
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    return train(np.concatenate(bags), bounds, np.array([found[i]["y"] for i in order], np.float32))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = []
        for x, bounds in passages(batch.column("text")):
            for a, b in zip(bounds[:-1], bounds[1:]):
                bags.append(x[a:b].astype(np.float16).tobytes())
        yield pa.record_batch([batch.column("y"), pa.array(bags, pa.binary())], names=["y", "x"])


def score(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """``docs`` with ``score``, the chance that a document is good, from its whole text.

    The text alone decides. A null or empty text has a score too, and without a model every score
    is 0.5. Rows and other columns stay as they are; a column ``score`` is replaced.
    """
    rest = docs.drop("score")
    if model is None:
        return rest.withColumn("score", F.lit(0.5))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        found = [model.score(x, bounds) for x, bounds in passages(texts)]
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return rest.withColumn("score", scored("text"))
