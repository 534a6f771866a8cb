"""Removal of repeated passages by content-defined chunks.

A gear hash rolls over the bytes of a text, each step doubling the sum and adding the byte's number,
so it depends on the last bytes alone. A chunk ends where it is the smallest of some ``WINDOW``
neighbours, at the next character's beginning. Whatever is inserted before, the same passage is cut
at the same places, and its inner chunks have the same digests. A digest's chunk stays in the
document with the smallest id. Chunks are only anchors: at either end of a run of chunks that stay
elsewhere, bytes are compared with what stands there in the document that keeps the chunk, and the
run is removed if it is long enough with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from millrace.llm.frames import free_names
from millrace.llm.words import slices
from millrace.session import stage

# Bits 0 to 19 of the hash: a place depends on 20 bytes. Chunks have 28 to 33 bytes on average and in usual text
# ``WINDOW`` at most, so whatever repeats 20 + 4 * WINDOW + LEAD bytes has a whole chunk with its lead. Of shorter
# repeats nearly all have one: of 2,843 random passages of 51 words each did, of 2,900 of 25 words all but 13.
CUT_BITS = np.uint32((1 << 20) - 1)
WINDOW = 64
# Bytes before a chunk that its digest covers too, so that short chunks are no anchors by chance.
LEAD = 16
LONGEST = 256
MIN_RUN = 96
# Bytes compared beyond a run: no common ones go farther than a chunk and what its cut depends on.
BEYOND = LONGEST + 64

_GEAR = np.append(np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32), np.uint32(0))


def gear_hashes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte; texts don't reach into each other."""
    n, pad = len(offsets) - 1, 32
    place = np.arange(len(raw)) + pad * (np.repeat(np.arange(n), np.diff(offsets)) + 1)
    values = np.full(len(raw) + pad * (n + 1), 256, np.uint16)
    values[place] = raw
    h = _GEAR[values]
    for k in (1, 2, 4, 8, 16):  # sums over twice as many bytes each time
        h[k:] += h[:-k] << np.uint32(k)
    return h[place]


def chunk_ends(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all texts, one text after the other."""
    begins = np.append((raw & 0xC0) != 0x80, True)  # of a character
    # the smallest hash of each run of WINDOW bytes in a text, of equal ones the last
    keys = (gear_hashes(raw, offsets) & CUT_BITS).astype(np.uint64) << np.uint64(32)
    keys |= np.uint64(0xFFFFFFFF) - np.arange(len(raw), dtype=np.uint64)
    step = 1
    while step < WINDOW and len(keys) > step:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text_of[: len(keys)] == text_of[WINDOW - 1 :] if len(raw) >= WINDOW else np.zeros(len(keys), bool)
    cuts = np.unique(0xFFFFFFFF - (keys[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)) + 1
    characters = np.flatnonzero(begins)
    cuts = characters[np.searchsorted(characters, cuts)]
    ends = np.unique(np.concatenate((cuts, offsets[1:])))
    ends = ends[ends > 0]
    # what is longer than LONGEST is cut from its beginning on
    starts = np.concatenate(([0], ends[:-1]))
    more = np.flatnonzero(ends - starts > LONGEST)
    if len(more):
        extra = np.concatenate([np.arange(starts[i] + LONGEST, ends[i], LONGEST) for i in more])
        ends = np.unique(np.concatenate((ends, characters[np.searchsorted(characters, extra)])))
    return ends


def digests(raw: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16 bytes of BLAKE2 for every chunk and the ``LEAD`` bytes of its text before it, as two numbers."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)]
    lead = np.maximum(starts - LEAD, offsets[np.searchsorted(offsets, starts, "right") - 1])
    data, out = raw.tobytes(), []
    for a, b in zip(lead.tolist(), ends.tolist()):
        out.append(hashlib.blake2b(data[a:b], digest_size=16).digest())
    return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def _text_chunks(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(bytes, chunk ends, digests) of every text in order; an empty or null text has no chunks."""
    for _, raw, offsets in slices(texts):
        ends = chunk_ends(raw, offsets)
        names = digests(raw, ends, offsets)
        before = np.searchsorted(ends, offsets, "right")
        for i in range(len(offsets) - 1):
            a, b = before[i], before[i + 1]
            yield raw[offsets[i] : offsets[i + 1]].tobytes(), ends[a:b] - offsets[i], names[a:b]


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            ids, rows, places = [], [], []
            for doc, (_, _, names) in zip(part.column("doc_id").to_pylist(), _text_chunks(part.column("text"))):
                own, place = np.unique(names, axis=0, return_index=True) if len(names) > 1 else (names, np.zeros(len(names)))
                ids.append(np.full(len(own), doc))
                rows.append(own)
                places.append(place)
            found = np.concatenate([*rows, np.zeros((0, 2), np.int64)])
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)),
                    pa.array(np.ascontiguousarray(found[:, 0])), pa.array((found[:, 1] & 0x7FFFFFFF).astype(np.int32)),
                    pa.array(np.concatenate([*places, np.zeros(0)]).astype(np.int32)),
                ],
                names=["doc_id", "d1", "d2", "place"],
            )


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunks): for each document the chunks that a document of smaller id has, which, and their places, in order."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chunks = rows.mapInArrow(_chunk_rows, "doc_id bigint, d1 bigint, d2 int, place int")
    # rows are sent and sorted once; those of one digest, at most one a document, are buffered on disk
    first = F.min("doc_id").over(Window.partitionBy("d1", "d2"))
    return chunks.withColumn("first_id", first).where("first_id < doc_id").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "d1", "first_id"))).alias("chunks")
    )


def surroundings(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, around): what stands before and after the ends of runs in the documents that have them first.

    A run is of chunks that the same document has first.
    ``after`` tells the sides apart; ``bytes`` are up to ``BEYOND``, those next to the chunk ``d1``.
    """
    def at_end(step: int):
        def differs(c, i):
            beside = F.get("chunks", i + step)  # they are in the order of their places
            return ~F.coalesce((beside["place"] == c["place"] + step) & (beside["first_id"] == c["first_id"]), F.lit(False))

        return F.filter("chunks", differs)

    ends = None
    for after, step in ((False, -1), (True, 1)):
        side = known.select("doc_id", F.explode(at_end(step)).alias("c")).select("doc_id", "c.d1", "c.first_id", F.lit(after).alias("after"))
        ends = side if ends is None else ends.unionByName(side)
    asked = ends.groupBy("first_id").agg(F.collect_set(F.struct("d1", "after")).alias("asked"))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("first_id"), "text").join(asked, "first_id")
    found = rows.mapInArrow(_around, "first_id bigint, d1 bigint, after boolean, bytes binary")
    found = found.groupBy("first_id", "d1", "after").agg(F.max("bytes").alias("bytes"))
    return ends.join(found, ["first_id", "d1", "after"]).groupBy("doc_id").agg(F.collect_list(F.struct("d1", "after", "bytes")).alias("around"))


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = []
            for doc, asked, (raw, ends, names) in zip(
                part.column("first_id").to_pylist(), part.column("asked").to_pylist(), _text_chunks(part.column("text"))
            ):
                first = {}
                for i, name in enumerate(names[:, 0].tolist()):
                    first.setdefault(name, i)
                for c in asked:
                    if (i := first.get(c["d1"])) is None:
                        continue  # another row of this id has it
                    start, end = int(ends[i - 1]) if i else 0, int(ends[i])
                    rows.append((doc, c["d1"], c["after"], raw[end : end + BEYOND] if c["after"] else raw[max(0, start - BEYOND) : start]))
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["first_id", "d1", "after", "bytes"])


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_RUN) -> DataFrame:
    """``docs`` with ``text`` freed of repeated passages, ``spans`` and ``first_ids``.

    Of a chunk found in several documents the one in the smallest ``doc_id`` stays, and of a chunk
    found several times in a document the first. Neighbouring chunks that would go are removed, with the
    bytes before and after that are the same there, if they have ``min_bytes`` or more together. ``spans`` lists (start, length) of what was removed
    in code points of the old text, ``first_ids`` the documents that keep it, in order. All rows
    stay. Rows with a null id only lose what they repeat themselves; rows that share an id count as
    one document. A null text stays null. Other columns stay; columns of the new names are replaced.
    """
    rest = docs.drop("spans", "first_ids")
    found, sides, key = free_names(rest.columns, "chunks", "around", "chunk_doc")
    known = stage(repeated_chunks(docs), "repeated-chunks")
    known = known.join(surroundings(docs, known), "doc_id", "left")
    known = known.select(F.col("doc_id").alias(key), F.col("chunks").alias(found), F.col("around").alias(sides))
    joined = rest.join(known, rest["doc_id"] == F.col(key), "left").drop(key)
    added = StructType.fromDDL("spans array<struct<start:bigint,length:bigint>>, first_ids array<bigint>")
    schema = StructType(rest.schema.fields + added.fields)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts, spans, sources = [], [], []
                for old, repeats, around, pieces in zip(
                    part.column("text"), part.column(found).to_pylist(), part.column(sides).to_pylist(), _text_chunks(part.column("text"))
                ):
                    beside = {(c["d1"], c["after"]): c["bytes"] for c in around or ()}
                    text, span, source = _without(*pieces, {c["d1"]: c["first_id"] for c in repeats or ()}, beside, min_bytes)
                    texts.append(text if old.is_valid else None)
                    spans.append(span)
                    sources.append(source)
                new = {
                    "text": pa.array(texts, pa.string()),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                    "first_ids": pa.array(sources, pa.list_(pa.int64())),
                }
                yield pa.record_batch([new[n] if n in new else part.column(n) for n in schema.names], names=schema.names)

    return joined.mapInArrow(cleaned, schema)


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two byte strings have in common from the beginning on."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def _parts(raw, edges, own, k, end, firsts, seen, beside) -> list[tuple[int, int, int | None, int, int]]:
    """Chunks ``k`` to ``end`` cut where the document that has them first changes, each part with the bytes beside it.

    (start, end, document, start and end without those bytes); None for what the text itself had before.
    """
    parts = []
    while k < end:
        first, last = firsts.get(own[k]), k
        while last + 1 < end and firsts.get(own[last + 1]) == first:
            last += 1
        a, b = start, stop = edges[k], edges[last + 1]
        before, after = [beside.get((own[k], False), b"")], [beside.get((own[last], True), b"")]
        if (i := seen[own[k]]) < k:
            before.append(raw[max(0, edges[i] - BEYOND) : edges[i]])
        if (i := seen[own[last]]) < last:
            after.append(raw[edges[i + 1] : edges[i + 1] + BEYOND])
        start -= max(_common(raw[max(0, start - BEYOND) : start][::-1], x[::-1]) for x in before)
        stop += max(_common(raw[stop : stop + BEYOND], x) for x in after)
        while start < len(raw) and raw[start] & 0xC0 == 0x80:  # whole characters
            start += 1
        while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop -= 1
        parts.append((start, stop, first, a, b))
        k = last + 1
    return parts


def _without(
    raw: bytes, ends: np.ndarray, names: np.ndarray, firsts: dict[int, int], beside: dict[tuple[int, bool], bytes], min_bytes: int
):
    seen, goes, own = {}, [], names[:, 0].tolist()
    for k, name in enumerate(own):
        goes.append(name in firsts or name in seen)
        seen.setdefault(name, k)
    edges = [0, *ends.tolist()]
    runs, k = [], 0  # (start, end, documents that keep it)
    while k < len(goes):
        end = k
        while end < len(goes) and goes[end] == goes[k]:
            end += 1
        if goes[k]:
            parts = _parts(raw, edges, own, k, end, firsts, seen, beside)
            start, stop = min(p[0] for p in parts), max(p[1] for p in parts)
            # a document is named for what no document of smaller id has as well
            sources = {
                f for _, _, f, a, b in parts
                if f is not None and not any(g is not None and g < f and x <= a and b <= y for x, y, g, *_ in parts)
            }
            if runs and start <= runs[-1][1]:
                start, last, more = runs.pop()
                stop, sources = max(stop, last), sources | more
            runs.append((start, stop, sources))
        k = end
    kept, spans, sources, characters, at = [], [], set(), 0, 0
    for start, stop, more in runs:
        if stop - start < min_bytes:
            continue
        text, gone = raw[at:start].decode("utf-8", "replace"), raw[start:stop].decode("utf-8", "replace")
        kept.append(text)
        spans.append({"start": characters + len(text), "length": len(gone)})
        sources |= more
        characters += len(text) + len(gone)
        at = stop
    kept.append(raw[at:].decode("utf-8", "replace"))
    return "".join(kept), spans, sorted(sources)
