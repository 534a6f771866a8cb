"""Document fingerprints from closed syncmers, with positions.

A k-mer of bytes is a closed syncmer if the smallest of the s-mers in it, by hash, is its first or
its last. Whether it is depends on nothing around it, so equal passages have equal anchors. Of
the anchors of a text the smallest hash of each of ``BINS`` classes is kept with its place;
two fingerprints are as alike as the share of classes with equal anchors at one common shift.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from millrace.llm.frames import bounded
from millrace.llm.words import mix, slices
from millrace.operators.prefix import dense_position
from millrace.session import stage

K, S = 20, 11
SHORT, SHORT_K = 64, 4
BINS = 64
PLACE_STEP = 16  # bytes to a unit of place; places count modulo 2**16
DRIFT = 64  # units that an anchor may be off the common shift
NONE = 0xFFFF
BROADCAST_ROWS = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64)


@functools.lru_cache(maxsize=2)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` bytes: a polynomial by prefix sums, freed of its place and mixed."""
    if len(raw) < size:
        return np.zeros(0, np.uint64)
    bits = max(21, int(len(raw)).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * _powers(_BASE, bits)[: len(raw)], dtype=np.uint64)))
    return mix((sums[size:] - sums[:-size]) * _powers(_INVERSE, bits)[: len(raw) - size + 1])


def closed_syncmers(raw: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the closed syncmers of some bytes."""
    if len(raw) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner = run_hashes(raw, s)
    width = k - s + 1
    least = inner[: len(inner) - width + 1].copy()
    for j in range(1, width):
        np.minimum(least, inner[j : len(inner) - width + 1 + j], out=least)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    return at, run_hashes(raw, k)[at]


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, BINS, 2) numbers: 16 bits of each class's smallest anchor and its place, or ``NONE``.

    Of a text of fewer than ``SHORT`` bytes every run of ``SHORT_K`` bytes is an anchor, or the whole
    text if it has fewer still; an empty text has none.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    at, hashes = closed_syncmers(raw)
    owner = np.searchsorted(offsets, at, "right") - 1
    inside = (at + K <= offsets[owner + 1]) & (lengths[owner] >= SHORT) if len(at) else np.zeros(0, bool)
    at, hashes, owner = at[inside], hashes[inside], owner[inside]
    for i in np.flatnonzero((lengths > 0) & (lengths < SHORT)):
        own = run_hashes(raw[offsets[i] : offsets[i + 1]], min(SHORT_K, int(lengths[i])))
        at = np.concatenate((at, offsets[i] + np.arange(len(own))))
        hashes, owner = np.concatenate((hashes, own)), np.concatenate((owner, np.full(len(own), i)))
    out = np.full((n, BINS, 2), NONE, np.uint16)
    if not len(at):
        return out
    bins = owner * BINS + (hashes >> np.uint64(58)).astype(np.int64)
    order = np.lexsort((at, hashes, bins))
    first = order[np.concatenate(([True], bins[order][1:] != bins[order][:-1]))]
    place = (at[first] - offsets[owner[first]]) // PLACE_STEP & 0xFFFF
    flat = out.reshape(-1, 2)
    flat[bins[first], 0] = np.minimum(hashes[first] & np.uint64(0xFFFF), NONE - 1)
    flat[bins[first], 1] = place
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the classes filled in either in which both have one anchor, at the common shift."""
    filled = (a[:, 0] != NONE) | (b[:, 0] != NONE)
    if not filled.any():
        return 1.0
    same = (a[:, 0] == b[:, 0]) & (a[:, 0] != NONE)
    if not same.any():
        return 0.0
    shift = (a[same, 1] - b[same, 1]).astype(np.int16).astype(np.int32)
    return float((np.abs(shift - np.median(shift)) <= DRIFT).sum() / filled.sum())


def spelled(fingerprint: np.ndarray) -> str:
    """A fingerprint in hexadecimal: eight digits a class."""
    return fingerprint.astype(">u2").tobytes().hex()


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` of each whole text; null is empty. Rows and other columns stay."""

    @F.arrow_udf("string")
    def made(texts: pa.Array) -> pa.Array:
        found = [spelled(f) for _, raw, offsets in slices(texts) for f in fingerprints(raw, offsets)]
        return pa.array(found, pa.string())

    return docs.withColumn("fingerprint", made(text))


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents, of the same documents with their last quarter exchanged, and likenesses.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): the
    edited text has its last floor(n_chars / 4) code points replaced by the first as many, or all,
    of the next document in ascending ``doc_id``; after the last comes the first. A null text is
    empty. Of rows that repeat an id the one whose text has the smallest hash stands for the id as a
    next document. A row without an id stands nowhere in the order; nothing follows it.

    The beginning that the document before needs is cut where a text is read, if the table of who
    follows whom is small enough to go to every task. Then texts cross the network once,
    compressed; in larger tables twice.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    places = stage(
        dense_position(
            rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("k").alias("k"), F.floor(F.max(F.length("text")) / 4).alias("need")),
            "doc_id",
        ),
        "document-order",
    )
    count = places.count()
    after = places.select(F.col("doc_id").alias("for_id"), "need", ((F.col("position") + 1) % max(count, 1)).alias("position"))
    wanted = after.join(places.select("doc_id", "k", "position"), "position").select("doc_id", F.col("k").alias("next_k"), "for_id", "need")

    sent = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "k", F.arrow_udf(_packed, "packed binary, own binary")("text").alias("p"))
    sent = sent.select("doc_id", "k", "p.packed", "p.own")
    heads = (
        sent.join(bounded(stage(wanted, "next-documents"), BROADCAST_ROWS), "doc_id").where("k = next_k").select("for_id", "need", "packed", "own")
        .mapInArrow(_heads, "for_id bigint, head binary, next binary")
        .groupBy("for_id").agg(F.first("head").alias("head"), F.first("next").alias("next"))
    )
    joined = sent.join(heads, F.col("doc_id") == F.col("for_id"), "left").select("doc_id", "packed", "own", "head", "next")
    return joined.mapInArrow(
        _edited,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _packed(texts: pa.Array) -> pa.Array:
    """Each text compressed, and its fingerprint."""
    pack = zstandard.ZstdCompressor(level=1)
    packed, own = [], []
    for _, raw, offsets in slices(texts, 1 << 19):
        own += [f.tobytes() for f in fingerprints(raw, offsets)]
        packed += [pack.compress(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
    return pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(own, pa.binary())], ["packed", "own"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    for batch in batches:
        heads = [
            pack.compress(unpack.decompress(p).decode("utf-8", "replace")[:need].encode())
            for p, need in zip(batch.column("packed").to_pylist(), batch.column("need").to_pylist())
        ]
        yield pa.record_batch([batch.column("for_id"), pa.array(heads, pa.binary()), batch.column("own")], names=["for_id", "head", "next"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    empty = np.full((BINS, 2), NONE, np.uint16)
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            sizes, edited, own, following = [], [], [], []
            for packed, mine, head, other in zip(*(part.column(c).to_pylist() for c in ("packed", "own", "head", "next"))):
                text = unpack.decompress(packed).decode("utf-8", "replace")
                cut = len(text) // 4
                beginning = unpack.decompress(head).decode() if head is not None else ""
                sizes.append(len(text))
                edited.append((text[: len(text) - cut] + beginning[:cut]).encode())
                own.append(np.frombuffer(mine, np.uint16).reshape(BINS, 2))
                following.append(empty if other is None else np.frombuffer(other, np.uint16).reshape(BINS, 2))
            offsets = np.concatenate(([0], np.cumsum([len(e) for e in edited])))
            changed = fingerprints(np.frombuffer(b"".join(edited), np.uint8), offsets)
            yield pa.record_batch(
                [
                    part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array([spelled(f) for f in own]), pa.array([spelled(f) for f in changed]),
                    pa.array([likeness(a, b) for a, b in zip(own, changed)]), pa.array([likeness(a, b) for a, b in zip(own, following)]),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
