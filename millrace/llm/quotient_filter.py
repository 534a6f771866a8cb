"""A counting quotient filter over packed n-grams of word ids: compact, sorted and without loss.

Three ids are one number of two halves. A Feistel network permutes it, so that any set of
n-grams is spread evenly, and the permutation can be undone. The highest bits of the result name the
shard, the next ones are the quotient and all others the remainder, which is kept in full: a
filter never takes one n-gram for another. Entries lie in order of quotient and remainder;
the quotients are a unary bit vector of run lengths, counters take a byte unless they are large.
Sorted filters of one shard merge into one.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_HEAD = struct.Struct("<BBBQQ")


@dataclass(frozen=True)
class Packing:
    """How ids of ``width`` bits (at most 42) become two halves, and ``shard_bits`` of them a shard."""

    width: int
    shard_bits: int

    @property
    def half(self) -> int:
        return max(-(-3 * self.width // 2), self.shard_bits + 1)

    def pack(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, low = np.uint64(self.width), np.uint64(self._low)
        first, second, third = (x.astype(np.uint64) for x in (first, second, third))
        return self._permute((first << (w - low)) | (second >> low), ((second & ((np.uint64(1) << low) - np.uint64(1))) << w) | third)

    def unpack(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right = self._restore(left, right)
        w, low = np.uint64(self.width), np.uint64(self._low)
        mask = (np.uint64(1) << w) - np.uint64(1)
        second = ((left << low) | (right >> w)) & mask
        return tuple(x.astype(np.int64) for x in (left >> (w - low), second, right & mask))

    @property
    def _low(self) -> int:
        """Bits of the second id that lie in the right half."""
        return min(self.half - self.width, self.width)

    def _round(self, x: np.ndarray, key: int) -> np.ndarray:
        x = (x + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(30))) & ((np.uint64(1) << np.uint64(self.half)) - np.uint64(1))

    def _permute(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for key in ROUNDS:
            left, right = right, left ^ self._round(right, key)
        return left, right

    def _restore(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for key in reversed(ROUNDS):
            left, right = right ^ self._round(left, key), left
        return left, right


@dataclass
class Filter:
    """Distinct permuted n-grams in order, with their counts."""

    packing: Packing
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, packing: Packing, left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None) -> Filter:
        """Sort and add up; ``counts`` of None are ones. Joined sorted runs are merged by the sort."""
        if 2 * packing.half <= 64:
            keys = (left << np.uint64(packing.half)) | right
            order = None if counts is None else np.argsort(keys, kind="stable")
            keys = np.sort(keys) if counts is None else keys[order]
            heads = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            left, right = keys[heads] >> np.uint64(packing.half), keys[heads] & ((np.uint64(1) << np.uint64(packing.half)) - np.uint64(1))
        else:
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            heads = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))) if len(left) else np.zeros(0, np.int64)
            left, right = left[heads], right[heads]
            keys = order
        if counts is None:
            sums = np.diff(np.append(heads, len(keys)))
        else:
            sums = np.add.reduceat(counts[order], heads) if len(heads) else counts[:0]
        return cls(packing, left, right, sums.astype(np.int64))

    @classmethod
    def merge(cls, packing: Packing, filters: list[Filter]) -> Filter:
        parts = [np.concatenate(x) for x in zip(*[(f.left, f.right, f.counts) for f in filters])]
        return cls.of(packing, *parts)

    def shards(self):
        """(shard, filter) of every shard that has entries."""
        shard = self.left >> np.uint64(self.packing.half - self.packing.shard_bits)
        heads = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
        for a, b in zip(heads, np.append(heads[1:], len(shard))):
            yield int(shard[a]), Filter(self.packing, self.left[a:b], self.right[a:b], self.counts[a:b])

    def to_bytes(self) -> bytes:
        """The entries of one shard: unary run lengths per quotient, remainders, counters."""
        p, n = self.packing, len(self.left)
        rest = p.half - p.shard_bits
        bits = min(max(n - 1, 1).bit_length(), rest)
        own = self.left & ((np.uint64(1) << np.uint64(rest)) - np.uint64(1))
        quotient = (own >> np.uint64(rest - bits)).astype(np.int64)
        unary = np.zeros(n + (1 << bits), np.uint8)
        unary[quotient + np.arange(n)] = 1
        large = self.counts > 255
        small = np.where(large, 0, self.counts).astype(np.uint8)
        remainder = own & ((np.uint64(1) << np.uint64(rest - bits)) - np.uint64(1))
        shard = int(self.left[0]) >> rest if n else 0
        return b"".join((
            _HEAD.pack(p.width, p.shard_bits, bits, shard, n), np.packbits(unary).tobytes(), _cut(remainder, rest - bits),
            _cut(self.right, p.half), small.tobytes(), self.counts[large].astype("<i8").tobytes(),
        ))

    @classmethod
    def from_bytes(cls, data: bytes) -> Filter:
        width, shard_bits, bits, shard, n = _HEAD.unpack_from(data)
        p, at = Packing(width, shard_bits), _HEAD.size
        rest = p.half - p.shard_bits

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        ones = np.flatnonzero(np.unpackbits(take(-(-(n + (1 << bits)) // 8))))
        quotient = (ones - np.arange(n)).astype(np.uint64)
        remainder = _whole(take(n * _bytes(rest - bits)), n, rest - bits)
        left = (np.uint64(shard) << np.uint64(rest)) | (quotient << np.uint64(rest - bits)) | remainder
        right = _whole(take(n * _bytes(p.half)), n, p.half)
        counts = take(n).astype(np.int64)
        large = counts == 0
        counts[large] = np.frombuffer(data, "<i8", int(large.sum()), at)
        return cls(p, left, right, counts)

    def ngrams(self, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and count of entries counted ``least`` times or more; the third id of a pair is zero."""
        keep = self.counts >= least
        return (*self.packing.unpack(self.left[keep], self.right[keep]), self.counts[keep])


def _bytes(bits: int) -> int:
    return -(-bits // 8)


def _cut(values: np.ndarray, bits: int) -> bytes:
    """The low bytes of each number that ``bits`` bits need."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : _bytes(bits)].tobytes()


def _whole(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : _bytes(bits)] = raw.reshape(n, _bytes(bits))
    return out.reshape(-1).view("<u8").astype(np.uint64)
