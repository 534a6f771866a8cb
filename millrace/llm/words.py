"""Words and word shingles of Arrow text batches as 64-bit hashes, by numpy over the raw bytes.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; ``A-Z`` is lower-cased. Null texts have no
words. Everything works on a few megabytes of whole texts at a time, so memory is bounded by
that and by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, 0xD6E8FEB86659FD93, dtype=np.uint64), dtype=np.uint64)
_ORDER = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit value."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n + 1 offsets; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) of runs of whole texts of about ``most`` bytes."""
    if not len(texts):
        return
    raw, offsets = text_bytes(texts)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


@dataclass
class Words:
    """Words of some texts in order: hash and byte span, and ``bounds`` of each text's words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, offsets: np.ndarray) -> Words:
        n = len(offsets) - 1
        if not len(raw):
            none = np.zeros(0, np.int64)
            return cls(np.zeros(0, np.uint64), none, none, np.zeros(n + 1, np.int64))
        solid = ~_SPACE[raw]
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[offsets] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | cut[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | cut[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        lengths = ends - starts
        at = np.flatnonzero(solid)
        if len(starts):
            heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            place = np.arange(len(at)) - np.repeat(heads, lengths)
            far = place >= len(_POWERS)
            value = _BYTE[raw[at]] * _POWERS[place & (len(_POWERS) - 1)]
            if far.any():
                value[far] *= mix((place[far] // len(_POWERS)).astype(np.uint64)) | np.uint64(1)
            hashes = mix(np.add.reduceat(value, heads) + lengths.astype(np.uint64) * _STEP)
        else:
            hashes = np.zeros(0, np.uint64)
        return cls(hashes, starts, ends, np.searchsorted(starts, offsets))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words of one text; of all its words if it has fewer."""
    if not len(words):
        return words
    take = min(size, len(words))
    count = len(words) - take + 1
    total = np.full(count, take * 0x51ED270B, dtype=np.uint64)
    for j in range(take):
        total += words[j : j + count] * _ORDER[j]
    return mix(total)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text, in order; empty for a text without words."""
    for _, raw, offsets in slices(texts):
        found = Words.of(raw, offsets)
        for a, b in zip(found.bounds[:-1], found.bounds[1:]):
            hashes = np.sort(shingle_hashes(found.hashes[a:b], size))
            if len(hashes) > 1:
                hashes = hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))]
            yield hashes
