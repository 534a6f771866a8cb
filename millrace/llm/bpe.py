"""Byte-level BPE of whole texts with a given vocabulary, merged for a whole batch at once.

The distinct pieces of an Arrow batch stand in one array of symbols. An index maps every pair of
neighbouring symbols that has a rank to all its positions. Active ranks are taken in ascending
order; a rank merges at all its positions together, and the pairs that arise beside them enter
the index. A merge can only make pairs of higher rank, so each rank comes up once.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm.words import mix, slices

GROUP_BYTES = 2 << 20
GROUP_IDS = 1 << 19


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file.

    Printable bytes stand for themselves, the others for the letters from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """Tables of a tokenizer file: ids of single bytes, ranked merges, bytes of every id."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray  # sorted left << 32 | right
    pair_ranks: np.ndarray
    merges: list[tuple[int, int, int]]  # by rank: left, right, merged
    starts: np.ndarray  # of each id's bytes; an id without bytes has none
    spelled: np.ndarray
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        pre = held["pre_tokenizer"] or {}
        if held["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE without normalizer and prefix space is read")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in held["added_tokens"]):
            raise ValueError("added tokens that take blanks or whole words only are not read")
        vocab = held["model"]["vocab"]
        letters = byte_letters()
        value = {letter: b for b, letter in enumerate(letters)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        keys = np.array([a << 32 | b for a, b, _ in merges] or [-1], np.int64)
        order = np.argsort(keys, kind="stable")
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        spelling = {i: bytes(value[c] for c in token) for token, i in vocab.items()}
        spelling |= {i: content.encode() for content, i in special.items()}
        parts = [spelling.get(i, b"") for i in range(max(spelling) + 1)]
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return cls(
            np.array([vocab[letter] for letter in letters], np.int64), keys[order], order.astype(np.int64), merges,
            starts, np.frombuffer(b"".join(parts), np.uint8), special,
        )

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)


def _distinct(places: np.ndarray) -> np.ndarray:
    places.sort()
    return places[np.concatenate(([True], places[1:] != places[:-1]))] if len(places) > 1 else places


class PairIndex:
    """Positions of every ranked pair in one array of symbols, by rank, lowest rank first."""

    def __init__(self, vocabulary: Vocabulary, raw: np.ndarray, bounds: np.ndarray):
        self.vocabulary = vocabulary
        self.bounds = bounds.astype(np.int64)
        n = len(raw)
        self.symbols = vocabulary.byte_ids[raw]
        self.next = np.arange(1, n + 1)
        self.before = np.arange(-1, n - 1)
        filled = self.bounds[:-1] < self.bounds[1:]
        self.next[self.bounds[1:][filled] - 1] = -1
        self.before[self.bounds[:-1][filled]] = -1
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._enter(np.flatnonzero(self.next >= 0))

    def _enter(self, at: np.ndarray) -> None:
        """Put the pairs that begin at these positions into the index."""
        if not len(at):
            return
        ranks = self.vocabulary.ranks(self.symbols[at], self.symbols[self.next[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        heads = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
        for rank, some in zip(ranks[heads].tolist(), np.split(at, heads[1:])):
            if rank not in self.places:
                self.places[rank] = []
                heapq.heappush(self.active, rank)
            self.places[rank].append(some)

    def merge_all(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all pieces, and where each piece's begin and end."""
        symbols, after, before = self.symbols, self.next, self.before
        while self.active:
            rank = heapq.heappop(self.active)
            left, right, merged = self.vocabulary.merges[rank]
            at = _distinct(np.concatenate(self.places.pop(rank)))
            at = at[(symbols[at] == left) & (after[at] >= 0)]
            at = at[symbols[after[at]] == right]
            if left == right and len(at) > 1:
                at = self._apart(at)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbols[at], symbols[gone] = merged, -1
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            prior = before[at]
            self._enter(_distinct(np.concatenate((prior[prior >= 0], at[inner]))))
        alive = symbols >= 0
        totals = np.concatenate(([0], np.cumsum(alive)))
        return symbols[alive], totals[self.bounds]

    def _apart(self, at: np.ndarray) -> np.ndarray:
        """Of equal neighbours such as aaa, every second pair from the left."""
        chain = np.concatenate(([False], self.next[at[:-1]] == at[1:]))
        place = np.arange(len(at))
        head = np.maximum.accumulate(np.where(chain, 0, place))
        return at[(place - head) % 2 == 0]


LETTER, NUMBER, SPACE, OTHER, SPECIAL = range(5)
# The code points of white space, the short forms that stand alone after an apostrophe.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_ONE, SHORT_TWO = "stmd", ("re", "ve", "ll")


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of every code point."""
    kind = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        first = unicodedata.category(chr(code))[0]
        if first in "LN":
            kind[code] = LETTER if first == "L" else NUMBER
    kind[WHITE] = SPACE
    return kind


def split_pieces(texts: list[str], special: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all texts as (bytes, piece ends and a leading 0, special id or -1, pieces before each text).

    A piece is a run of letters, of digits or of other characters, with the blank before it; what
    is left of white space before that blank; or an apostrophe with a short form.
    """
    joined = "".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    kind = _kinds()[code]
    fresh = np.zeros(len(code) + 1, dtype=bool)  # nothing reaches over these places
    fresh[bounds] = True
    fixed: dict[int, int] = {}
    for t, text in enumerate(texts):
        if any(content in text for content in special):
            for found in _splitter(tuple(special)).finditer(text):
                a, b = bounds[t] + found.start(), bounds[t] + found.end()
                fresh[[a, b]] = True
                kind[a:b] = SPECIAL
                fixed[int(a)] = special[found.group()]
    begins = fresh[:-1].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    heads = np.flatnonzero(begins)
    kinds, tails = kind[heads], np.append(heads[1:], len(code))
    first = begins.copy()  # of a piece
    space = (kinds == SPACE) & ~fresh[tails]
    last = tails[space] - 1
    first[last] = True
    joins = code[last] == 32
    first[last[joins] + 1] = False
    lone = (kinds == OTHER) & (tails - heads == 1) & ~fresh[tails] & (code[heads] == ord("'")) & first[heads]
    lone = heads[lone]
    lone = lone[kind[lone + 1] == LETTER] if len(lone) else lone
    padded = np.append(code, [0, 0])
    one = np.isin(padded[lone + 1], [ord(c) for c in SHORT_ONE])
    two = np.zeros(len(lone), dtype=bool)
    for pair in SHORT_TWO:
        two |= (padded[lone + 1] == ord(pair[0])) & (padded[lone + 2] == ord(pair[1]))
    two &= ~np.append(fresh, True)[lone + 2]
    for at, size in ((lone[one], 1), (lone[two & ~one], 2)):
        first[at + 1] = False
        rest = at + 1 + size
        first[rest[rest < len(code)]] = True
    widths = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    byte_at = np.concatenate(([0], np.cumsum(widths)))
    starts = np.flatnonzero(first)
    ids = np.full(len(starts), -1, np.int64)
    if fixed:
        ids[np.searchsorted(starts, list(fixed))] = list(fixed.values())
    return (
        np.frombuffer(joined.encode(), np.uint8), np.append(byte_at[starts], byte_at[-1]), ids, np.searchsorted(starts, bounds)
    )


@functools.lru_cache(maxsize=8)
def _splitter(special: tuple[str, ...]):
    return re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


def distinct_pieces(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each piece, first piece of each number): equal bytes have equal numbers."""
    starts, sizes = ends[:-1], np.diff(ends)
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    rng = np.random.default_rng(11)
    while True:
        letter = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        power = np.cumprod(np.full(int(sizes.max()) + 1, rng.integers(1 << 62, 1 << 63, dtype=np.uint64) | np.uint64(1)), dtype=np.uint64)
        hashes = mix(np.add.reduceat(letter[raw] * power[place], starts))
        number, values = pd.factorize(hashes)
        example = np.zeros(len(values), np.int64)
        example[number[::-1]] = np.arange(len(number))[::-1]
        like = example[number]
        if (sizes[like] == sizes).all() and (raw[_spans(starts[like], sizes)] == raw).all():
            return number, example
        # two different pieces met in one hash: draw another hash function


def encode_texts(vocabulary: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of the texts; a null text has no ids."""
    raw, ends, fixed, before = split_pieces([t or "" for t in texts], vocabulary.special)
    number, example = distinct_pieces(raw, ends)
    sizes = np.where(fixed[example] < 0, np.diff(ends)[example], 0)
    symbols = raw[_spans(ends[:-1][example], sizes)]
    ids, bounds = PairIndex(vocabulary, symbols, np.concatenate(([0], np.cumsum(sizes)))).merge_all()
    sizes, starts = np.diff(bounds), bounds[:-1]
    if (fixed >= 0).any():  # special tokens stand behind the others
        own = np.flatnonzero(fixed[example] >= 0)
        starts, sizes = starts.copy(), sizes.copy()
        starts[own], sizes[own] = len(ids) + np.arange(len(own)), 1
        ids = np.concatenate((ids, fixed[example][own]))
    uses = sizes[number]
    flat = ids[_spans(starts[number], uses)]
    return flat.astype(np.int32), np.concatenate(([0], np.cumsum(uses)))[before]


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Texts of runs of ids; ids out of the vocabulary have no bytes, broken UTF-8 is replaced."""
    ids = ids.astype(np.int64)
    known = (ids >= 0) & (ids < len(vocabulary.starts) - 1)
    ids = np.where(known, ids, 0)
    sizes = np.where(known, np.diff(vocabulary.starts)[ids], 0)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    raw = vocabulary.spelled[_spans(vocabulary.starts[ids], sizes)].tobytes()
    at = ends[bounds].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def shared_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The tables of a tokenizer file, read once; its size is that of the vocabulary."""
    return spark.sparkContext.broadcast(Vocabulary.read(path))


def encode(docs: DataFrame, vocabulary: Broadcast, text: str = "text", out: str = "input_ids") -> DataFrame:
    """``docs`` with the ids of each whole text; a null or empty text has none.

    Special tokens' strings in a text become their ids. Rows and other columns stay; a column
    named ``out`` is replaced.
    """

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        found = []
        for at, _, offsets in slices(texts, GROUP_BYTES):
            ids, bounds = encode_texts(vocabulary.value, texts.slice(at, len(offsets) - 1).to_pylist())
            found.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)))
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(out, encoded(text))


def decode(docs: DataFrame, vocabulary: Broadcast, ids: str = "input_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of each list of ids; a null list is an empty text."""

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        lengths = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
        flat = lists.flatten()
        flat = flat.fill_null(-1) if flat.null_count else flat
        bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        flat, found, at = flat.to_numpy(zero_copy_only=False), [], 0
        while at < len(lists):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + GROUP_IDS, "right")) - 1)
            own = bounds[at : end + 1]
            found.append(pa.array(decode_ids(vocabulary.value, flat[own[0] : own[-1]], own - own[0]), pa.string()))
            at = end
        return pa.concat_arrays(found) if found else pa.array([], pa.string())

    return docs.withColumn(out, decoded(ids))
