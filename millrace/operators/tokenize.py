"""Word vocabulary, encoding and decoding, chat encoding with label masks, preference pairs."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from millrace.functions import arrays as A
from millrace.functions.text import WORD, strip, words
from millrace.operators.normalize import join_turns
from millrace.operators.prefix import running_offset
from millrace.session import small_batches, stage

# Reserved ids and the vocabulary size that 16-bit ids were chosen for.
EOS, PAD, UNK, NEWLINE = 0, 1, 2, 3
ROLE_IDS = {"user": 4, "assistant": 5, "system": 6}
RESERVED = ("<|endoftext|>", "<|padding|>", "<|unknown|>", "\n", "<|user|>", "<|assistant|>", "<|system|>")
VOCAB_SIZE = 50280
MAX_VOCAB = 65536
# The last ids of 16 bits: the end of a word spelled in bytes, and the bytes.
WORD_END, FIRST_BYTE = MAX_VOCAB - 257, MAX_VOCAB - 256
MAX_WORDS = WORD_END - 7
SEQ_LEN = 4096
_WORD = re.compile(WORD)


def build_vocab(texts: DataFrame, text: str = "text", size: int = VOCAB_SIZE) -> DataFrame:
    """(token, token_id, n): words by (count desc, word asc) after the reserved ids.

    Counts combine before the shuffle; the cap makes the ranked list at most ``size`` rows,
    so ranking it in one task is bounded whatever the corpus.
    """
    if size - len(RESERVED) > MAX_WORDS:
        raise ValueError("ids must fit 16 bits")
    counts = texts.select(F.explode(words(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(size - len(RESERVED))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("token")))
    return top.select("token", (rank + (len(RESERVED) - 1)).cast("bigint").alias("token_id"), "n")


def _lists(like: pa.Array, values: pa.Array) -> pa.Array:
    """Values cut into lists as long as those of ``like``."""
    starts = pc.subtract(like.offsets, like.offsets[0]).cast(pa.int32())
    return pa.ListArray.from_arrays(starts, values)


def word_bytes(word: str) -> list[int]:
    """Ids of a word that has none of its own: its UTF-8 bytes and the mark that ends them."""
    return [*(FIRST_BYTE + b for b in word.encode()), WORD_END]


class Words:
    """A vocabulary as a task sees it: word to ids and back."""

    def __init__(self, words: Sequence[str]):
        self.ids = {w: i + len(RESERVED) for i, w in enumerate(words)}
        self.spelled = [*RESERVED, *words]

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each word's begin); every distinct word is looked up once."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        ids = [[self.ids[w]] if w in self.ids else word_bytes(w) for w in distinct]
        sizes = np.array([len(x) for x in ids] or [0])
        flat = np.array([i for x in ids for i in x], np.int32)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        own = sizes[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.cumsum(own)
        places = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - own), own) + np.arange(ends[-1]) if len(codes) else np.zeros(0, np.int64)
        return flat[places], np.concatenate(([0], ends)).astype(np.int64)

    def decode(self, ids: list[int]) -> list[str]:
        """Words of ids; bytes without their end mark are a word too."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i >= FIRST_BYTE:
                held.append(i - FIRST_BYTE)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i != WORD_END:
                out.append(self.spelled[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return out


_held: dict[int, Words] = {}


def _words_of(shared: Broadcast) -> Words:
    """The tables of a vocabulary, built once per worker."""
    number = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) is not None else id(shared.value)
    if number not in _held:
        _held.clear()
        _held[number] = Words(shared.value)
    return _held[number]


class Vocabulary:
    """A vocabulary of at most ``MAX_WORDS`` words, shipped once to every executor.

    Words are looked up a batch at a time and stay inside the row: no token is ever exploded,
    joined or shuffled. A word without an id is spelled in bytes, so no text loses any.
    """

    def __init__(self, spark: SparkSession, tokens: Sequence[str]):
        if len(tokens) > MAX_WORDS:
            raise ValueError("ids must fit 16 bits")
        self.size = len(tokens) + len(RESERVED)
        small_batches(spark)
        self._shared = spark.sparkContext.broadcast(list(tokens))

    @classmethod
    def from_table(cls, table: DataFrame) -> Vocabulary:
        """From (token, token_id) rows with dense ids after the reserved ones."""
        ranked = table.select("token", "token_id").limit(MAX_WORDS + 1).toArrow()
        if ranked.num_rows > MAX_WORDS:
            raise ValueError("ids must fit 16 bits")
        ranked = ranked.sort_by("token_id")
        ids = ranked["token_id"].to_pylist()
        if ids != list(range(len(RESERVED), len(RESERVED) + len(ids))):
            raise ValueError("ids must be unique and dense after the reserved ones")
        return cls(table.sparkSession, ranked["token"].to_pylist())

    @classmethod
    def of(cls, texts: DataFrame, text: str = "text", size: int = VOCAB_SIZE) -> Vocabulary:
        return cls.from_table(build_vocab(texts, text, size))

    def encode_words(self, word_array: Column) -> Column:
        """Ids of an array of words."""
        shared = self._shared

        @F.arrow_udf("array<int>")
        def encode(batch: pa.Array) -> pa.Array:
            ids, ends = _words_of(shared).encode(batch.flatten().cast(pa.string()))
            starts = ends[np.asarray(batch.offsets) - batch.offsets[0].as_py()]
            return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))

        return encode(F.coalesce(word_array, F.array().cast("array<string>")))

    def encode(self, text: Column | str) -> Column:
        """Ids of a text; it is split in the same step that looks its words up."""
        shared = self._shared

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            found = [_WORD.findall(t) for t in texts.to_pylist()]
            ids, ends = _words_of(shared).encode(pa.array([w for ws in found for w in ws], pa.string()))
            starts = ends[np.cumsum([0, *map(len, found)])]
            return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))

        return encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))

    def encode_each(self, texts: Column) -> Column:
        """Ids of every text of an array of texts."""
        shared = self._shared

        @F.arrow_udf("array<array<int>>")
        def encode(batch: pa.Array) -> pa.Array:
            inner = batch.flatten()
            ids, ends = _words_of(shared).encode(inner.flatten().cast(pa.string()))
            starts = ends[np.asarray(inner.offsets) - inner.offsets[0].as_py()]
            return _lists(batch, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())))

        return encode(F.transform(texts, words))

    def decode_words(self, ids: Column) -> Column:
        """Words of an array of ids."""
        shared = self._shared

        @F.arrow_udf("array<string>")
        def decode(batch: pa.Array) -> pa.Array:
            table = _words_of(shared)
            return pa.array([table.decode(x) for x in batch.to_pylist()], pa.list_(pa.string()))

        return decode(F.coalesce(ids, F.array().cast("array<int>")))

    def decode(self, ids: Column, skip_special: bool = True) -> Column:
        """Text of an array of ids, words joined by a blank."""
        kept = F.filter(ids, lambda x: x >= len(RESERVED)) if skip_special else ids
        return F.array_join(self.decode_words(kept), " ")


class BatchTokenizer:
    """Any tokenizer that encodes a list of texts, in the place of a vocabulary.

    It runs on Arrow batches inside the tasks; the texts stay where they are.
    """

    def __init__(self, encode_batch: Callable[[list[str]], list[list[int]]]):
        self._encode_batch = encode_batch

    def encode(self, text: Column | str) -> Column:
        encode_batch = self._encode_batch

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            return pa.array(encode_batch(texts.to_pylist()), pa.list_(pa.int32()))

        return encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))

    def encode_each(self, texts: Column) -> Column:
        encode_batch = self._encode_batch

        @F.arrow_udf("array<array<int>>")
        def encode(batch: pa.Array) -> pa.Array:
            ids = pa.array(encode_batch(batch.flatten().to_pylist()), pa.list_(pa.int32()))
            return _lists(batch, ids)

        return encode(F.transform(texts, lambda t: F.coalesce(t, F.lit(""))))


def encode_documents(
    docs: DataFrame,
    vocab: Vocabulary | BatchTokenizer,
    text: str = "text",
    add_special: bool = True,
    truncate_to: int | None = None,
    side: str = "right",
    out: str = "input_ids",
) -> DataFrame:
    """Text to ids, then truncation, then eos. The limit leaves room for the eos."""
    encoded = docs.withColumn(out, vocab.encode(text))
    if truncate_to is not None:
        limit = truncate_to - 1 if add_special else truncate_to
        encoded = encoded.withColumn(out, A.truncate(F.col(out), limit, side))
    if add_special:
        encoded = encoded.withColumn(out, A.append_once(F.col(out), EOS))
    return encoded


def role_id(role: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, value in ROLE_IDS.items():
        out = out.when(role == name, F.lit(value))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("NULL")))).cast("int"))


def turn_ids(role: Column, content: Column) -> Column:
    """A turn's ids: role line, content, a newline; a reply has an eos before the newline."""
    head = F.array(role_id(role), F.lit(NEWLINE))
    tail = F.when(role == "assistant", F.array(F.lit(EOS), F.lit(NEWLINE))).otherwise(F.array(F.lit(NEWLINE)))
    return F.concat(head, content, tail)


def turn_mask(role: Column, content: Column) -> Column:
    """A turn's label mask: true for a reply's content and eos, not for its newline."""
    reply = role == "assistant"
    tail = F.when(reply, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    return F.concat(F.array(F.lit(False), F.lit(False)), F.array_repeat(reply, F.size(content)), tail)


def encode_turns(turns: DataFrame, vocab: Vocabulary | BatchTokenizer, role: str = "role", text: str = "text") -> DataFrame:
    """Per turn its ids and label mask; the message is stripped first."""
    encoded = turns.withColumn("__content", vocab.encode(strip(F.col(text))))
    return (
        encoded.withColumn("ids", turn_ids(F.col(role), F.col("__content")))
        .withColumn("mask", turn_mask(F.col(role), F.col("__content")))
        .drop("__content")
    )


def chat_encode(
    turns: DataFrame,
    vocab: Vocabulary | BatchTokenizer,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    seq_len: int | None = None,
) -> DataFrame:
    """Ids and label mask of conversations, each starting with an unlabelled eos.

    With ``seq_len`` a row per conversation, (key, input_ids, label_mask), put together from the
    turns that start within the first ``seq_len`` tokens: at most ``seq_len / 3`` of them and one
    more, however many there are. Without it a row per turn, (key, order, start, input_ids,
    label_mask), ``start`` being its place among the conversation's tokens, of which the eos has
    place 0; that holds at every length. Turns with a null key are one conversation.
    """
    encoded = stage(encode_turns(turns, vocab, role, text).select(key, order, "ids", "mask"), "turn-ids")
    # only sizes are put in order
    starts = running_offset(encoded.select(key, order, F.size("ids").alias("n")), order, F.col("n"), by=[key], out="start")
    starts = starts.select(F.col(key).alias("__key"), F.col(order).alias("__order"), (F.col("start") + 1).alias("start"))
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col(order).eqNullSafe(F.col("__order"))
    placed = encoded.join(starts, same).drop("__key", "__order")
    if seq_len is None:
        return placed.select(key, order, "start", F.col("ids").alias("input_ids"), F.col("mask").alias("label_mask"))
    # turns beyond the length are nulls, which are not collected; the conversation stays
    reaching = F.when(F.col("start") < seq_len, F.struct("start", "ids", "mask"))
    joined = placed.groupBy(key).agg(F.array_sort(F.collect_list(reaching)).alias("turns"))
    return joined.select(
        key,
        F.concat(F.array(F.lit(EOS)), F.flatten(F.col("turns.ids"))).alias("input_ids"),
        F.concat(F.array(F.lit(False)), F.flatten(F.col("turns.mask"))).alias("label_mask"),
    )


def chat_lengths(turns: DataFrame, vocab: Vocabulary | BatchTokenizer, key: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """(key, n_full): tokens of each whole conversation, summed without putting it together."""
    sizes = encode_turns(turns, vocab, role, text).select(key, F.size("ids").alias("n"))
    return sizes.groupBy(key).agg((F.sum("n") + 1).cast("bigint").alias("n_full"))


def fit_to_length(df: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Cut on the right, then fill ids with pad and the mask with false; count labels."""
    ids = A.pad(A.truncate(F.col("input_ids"), seq_len), seq_len, F.lit(PAD))
    mask = A.pad(A.truncate(F.col("label_mask"), seq_len), seq_len, F.lit(False))
    fitted = df.withColumn("input_ids", ids).withColumn("label_mask", mask)
    return fitted.withColumn("n_labels", A.count_true(F.col("label_mask")))


def count_tokens(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and tokens; padding counts."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.size("input_ids")), F.lit(0)).cast("bigint").alias("n_tokens"),
    )


def encode_preferences(
    pairs: DataFrame, vocab: Vocabulary | BatchTokenizer, key: str = "pair_id", seq_len: int = 2048, bos: int | None = None
) -> DataFrame:
    """Both sides of each pair as ids, labels and attention mask.

    Sides are row-local arrays of messages, so nothing is shuffled. ``bos`` is put in front
    and refused when the encoding already begins with it.
    """
    if bos == EOS:
        raise ValueError("the encoding already begins with this token")
    out = pairs
    for side in ("chosen", "rejected"):
        checked = F.when(F.size(side) > 0, F.col(side)).otherwise(
            F.raise_error(F.lit(f"{side} messages field is empty")).cast(pairs.schema[side].dataType)
        )
        out = out.withColumn(side, checked)
        out = out.withColumn("__ids", vocab.encode_each(F.transform(side, lambda m: strip(m["content"]))))
        start_ids = [EOS] if bos is None else [bos, EOS]
        start = F.array(*[F.lit(x) for x in start_ids])
        start_mask = F.array(*[F.lit(False) for _ in start_ids])
        ids = F.zip_with(side, "__ids", lambda m, x: turn_ids(m["role"], x))
        mask = F.zip_with(side, "__ids", lambda m, x: turn_mask(m["role"], x))
        out = out.withColumn(f"{side}_input_ids", A.truncate(F.concat(start, F.flatten(ids)), seq_len))
        mask = F.concat(start_mask, F.flatten(mask))
        labels = F.zip_with(
            F.col(f"{side}_input_ids"),
            A.truncate(mask, seq_len),
            lambda x, m: F.when(m, x).otherwise(F.lit(A.IGNORED)),
        )
        out = out.withColumn(f"{side}_labels", labels)
        out = out.withColumn(f"{side}_attention_mask", F.transform(f"{side}_input_ids", lambda x: F.lit(1)))
        out = out.drop("__ids")
    names = [f"{s}_{p}" for s in ("chosen", "rejected") for p in ("input_ids", "labels", "attention_mask")]
    return out.select(key, *names)


def prompt_line(role: Column, content: Column) -> Column:
    """A turn of a prompt: role line and message, or an open role line."""
    head = F.concat(F.lit("<|"), role, F.lit("|>\n"))
    empty = F.coalesce(F.length(content), F.lit(0)) == 0
    return F.when(empty, head).otherwise(F.concat(head, content, F.lit("\n")))


def render_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, text): prompts of long-form turns whose final reply is left to the model."""
    last = turns.groupBy(key).agg(F.max(order).alias("__last"))
    open_end = (F.col(order) == F.col("__last")) & (F.col(role) == "assistant")
    lines = turns.join(last, key).withColumn(
        "__line", prompt_line(F.col(role), F.when(open_end, F.lit("")).otherwise(F.col(text)))
    )
    start = turns.select(key).distinct().select(
        key, F.lit(-1).cast(turns.schema[order].dataType).alias(order), F.lit(RESERVED[EOS]).alias("__line")
    )
    pieces = lines.select(key, order, "__line").unionByName(start)
    return join_turns(pieces, F.col("__line"), key, order)


def render_chat_prompt(messages: Column, system: Column | None = None) -> Column:
    """Prompt text: an end marker, then role and message lines.

    An absent or empty message leaves its role line open, for the model to complete.
    """
    body = F.array_join(F.transform(messages, lambda m: prompt_line(m["role"], m["content"])), "")
    start = F.lit(RESERVED[EOS])
    if system is not None:
        filled = F.coalesce(F.length(system), F.lit(0)) > 0
        start = F.concat(F.when(filled, F.concat(system, F.lit("\n"))).otherwise(F.lit("")), start)
    return F.concat(start, body)
