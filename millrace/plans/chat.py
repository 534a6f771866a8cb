"""Queries from texts and chat records to token rows, labels and preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from millrace.functions import arrays as A
from millrace.operators import ordering, quality, tokenize
from millrace.plans.corpus import SQL_QA, _questions
from millrace.plans.registry import query, spread_table, table
from millrace.plans.shared import (
    CHAT_LEN,
    EOS_PLACE,
    SEED,
    SQL_CHAT_FIT,
    SQL_CHAT_FLAT,
    SQL_DOC_TOKENS,
    VOCAB,
    chat_vocab,
    doc_vocab,
    joined_ids,
    sql_chat_flat,
    sql_md5,
    sql_vocab,
    sql_words,
)
from millrace.session import fresh_path, stage
from millrace.sources import flat_tokens, readers, writers

PAIR_LEN = 2048


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def _encoded_chats(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.chat_encode(_turns(spark, sf), chat_vocab(spark, sf), seq_len=CHAT_LEN)


def _fitted(encoded: DataFrame) -> DataFrame:
    return tokenize.fit_to_length(encoded, CHAT_LEN)


def _chat_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-length chat rows (conv_id, input_ids, label_mask, n_labels)."""
    return _fitted(_encoded_chats(spark, sf))


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("input_ids", joined_ids(F.col("input_ids"))).withColumn(
        "label_mask", joined_ids(F.col("label_mask"))
    )


@query("build_vocab", f"SELECT w AS token, id AS token_id, n FROM ({sql_vocab('documents')})")
def build_vocab(spark, sf):
    return tokenize.build_vocab(spread_table(spark, sf, "documents", "text"), size=VOCAB)


@query("encode_documents", f"""WITH {SQL_DOC_TOKENS}
SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS input_ids, count(*) AS n_tokens FROM dtok GROUP BY doc_id""")
def encode_documents(spark, sf):
    docs = spread_table(spark, sf, "documents", "doc_id", "text")
    encoded = tokenize.encode_documents(docs, doc_vocab(spark, sf))
    return encoded.select(
        "doc_id", joined_ids(F.col("input_ids")).alias("input_ids"), F.size("input_ids").cast("bigint").alias("n_tokens")
    )


@query("append_eos", f"""WITH {SQL_DOC_TOKENS},
raw AS (SELECT doc_id, pos, id FROM dtok WHERE pos < {EOS_PLACE})
SELECT doc_id, count(id) + 1 AS n_once, count(id) + 1 AS n_twice, CAST(0 AS BIGINT) AS last_id
FROM (SELECT doc_id FROM documents) LEFT JOIN raw USING (doc_id) GROUP BY doc_id""")
def append_eos(spark, sf):
    docs = spread_table(spark, sf, "documents", "doc_id", "text")
    plain = tokenize.encode_documents(docs, doc_vocab(spark, sf), add_special=False)
    once = plain.withColumn("once", A.append_once(F.col("input_ids"), tokenize.EOS))
    twice = once.withColumn("twice", A.append_once(F.col("once"), tokenize.EOS))
    return twice.select(
        "doc_id",
        F.size("once").cast("bigint").alias("n_once"),
        F.size("twice").cast("bigint").alias("n_twice"),
        F.element_at("twice", -1).cast("bigint").alias("last_id"),
    )


@query("truncate_tokens", f"""WITH {SQL_DOC_TOKENS},
raw AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS h,
               row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS t FROM dtok WHERE pos < {EOS_PLACE})
SELECT doc_id, coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY h) FILTER (h <= 63) || ' ', '') || '0' AS head_ids,
       coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY h) FILTER (t <= 63) || ' ', '') || '0' AS tail_ids
FROM (SELECT doc_id FROM documents) LEFT JOIN raw USING (doc_id) GROUP BY doc_id""")
def truncate_tokens(spark, sf):
    docs = spread_table(spark, sf, "documents", "doc_id", "text")
    vocab = doc_vocab(spark, sf)
    head = tokenize.encode_documents(docs, vocab, truncate_to=64, side="right", out="head_ids")
    both = tokenize.encode_documents(head, vocab, truncate_to=64, side="left", out="tail_ids")
    return both.select("doc_id", joined_ids(F.col("head_ids")).alias("head_ids"), joined_ids(F.col("tail_ids")).alias("tail_ids"))


@query("decode_tokens", f"SELECT doc_id, array_to_string({sql_words('text')}, ' ') AS decoded FROM documents")
def decode_tokens(spark, sf):
    vocab = doc_vocab(spark, sf)
    encoded = tokenize.encode_documents(spread_table(spark, sf, "documents", "doc_id", "text"), vocab)
    return encoded.select("doc_id", vocab.decode(F.col("input_ids"), skip_special=True).alias("decoded"))


@query("chat_encode", f"""WITH {SQL_CHAT_FLAT},
by_turn AS (SELECT conv_id, turn, count(*) AS n, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY part, pos) AS input_ids,
       string_agg(CAST(CAST(lab AS INTEGER) AS VARCHAR), ' ' ORDER BY part, pos) AS label_mask FROM seg GROUP BY ALL)
SELECT conv_id, turn, CAST(1 + sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS BIGINT) AS start, input_ids, label_mask FROM by_turn""")
def chat_encode(spark, sf):
    return _as_text(tokenize.chat_encode(_turns(spark, sf), chat_vocab(spark, sf)))


@query("fit_to_length", f"WITH {SQL_CHAT_FIT} SELECT * FROM rows_")
def fit_to_length(spark, sf):
    return _as_text(_chat_rows(spark, sf))


@query("has_labels", f"""WITH {SQL_CHAT_FIT.replace(f"range({CHAT_LEN})", "range(48)")} SELECT * FROM rows_ WHERE n_labels > 0""")
def has_labels(spark, sf):
    short = tokenize.chat_encode(_turns(spark, sf), chat_vocab(spark, sf), seq_len=48)
    return _as_text(quality.has_labels(tokenize.fit_to_length(short, 48), Observation()))


@query("count_tokens", f"""WITH {SQL_CHAT_FIT},
kept AS (SELECT conv_id, n_labels, CASE split_part(input_ids, ' ', 2) WHEN '4' THEN 'user' WHEN '5' THEN 'assistant' ELSE 'system' END AS first_role
         FROM rows_ WHERE n_labels > 0)
SELECT coalesce(first_role, 'total') AS first_role, count(*) AS n_rows, CAST(count(*) * {CHAT_LEN} AS BIGINT) AS n_tokens,
       CAST(sum(n_labels) AS BIGINT) AS n_labels FROM kept GROUP BY ROLLUP (first_role)""")
def count_tokens(spark, sf):
    kept = quality.has_labels(_chat_rows(spark, sf))
    names = F.create_map(*[x for k, v in tokenize.ROLE_IDS.items() for x in (F.lit(v), F.lit(k))])
    slim = kept.select(
        names[F.element_at("input_ids", 2)].alias("first_role"),
        F.size("input_ids").cast("bigint").alias("size"),
        "n_labels",
    )
    return slim.rollup("first_role").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("size").cast("bigint").alias("n_tokens"),
        F.sum("n_labels").cast("bigint").alias("n_labels"),
    ).withColumn("first_role", F.coalesce("first_role", F.lit("total")))


@query("write_token_shards", f"""WITH {SQL_CHAT_FIT}
SELECT conv_id, md5(input_ids) AS ids_md5, md5(label_mask) AS mask_md5, CAST({CHAT_LEN} AS BIGINT) AS n_tokens FROM rows_""")
def write_token_shards(spark, sf):
    path = fresh_path(spark, "shards")
    # rows are put in order before they are filled up
    writers.write_token_shards(_encoded_chats(spark, sf), path, "conv_id", finish=_fitted, bits=12)
    back = spark.read.parquet(path)
    return back.select(
        "conv_id",
        F.md5(joined_ids(F.col("input_ids"))).alias("ids_md5"),
        F.md5(joined_ids(F.col("label_mask"))).alias("mask_md5"),
        F.size("input_ids").cast("bigint").alias("n_tokens"),
    )


@query("flat_token_files", f"""WITH {SQL_CHAT_FIT}
SELECT row_number() OVER (ORDER BY conv_id) - 1 AS instance_id, md5(input_ids) AS ids_md5, md5(label_mask) AS mask_md5 FROM rows_""")
def flat_token_files(spark, sf):
    """Rows written end to end without structure and cut into chunks again."""
    path = fresh_path(spark, "flat")
    flat_tokens.write_flat_tokens(_encoded_chats(spark, sf), path, "conv_id", finish=_fitted)
    back = flat_tokens.read_flat_tokens(spark, path, CHAT_LEN)
    return back.select("instance_id", F.md5(joined_ids(F.col("input_ids"))).alias("ids_md5"), F.md5(joined_ids(F.col("label_mask"))).alias("mask_md5"))


@query("attention_mask", f"""WITH {SQL_CHAT_FIT}
SELECT conv_id, string_agg(CAST(CAST(id <> 1 AS INTEGER) AS VARCHAR), ' ' ORDER BY p) AS attention_mask FROM fit GROUP BY conv_id""")
def attention_mask(spark, sf):
    rows = _chat_rows(spark, sf)
    return rows.select("conv_id", joined_ids(A.attention(F.col("input_ids"), tokenize.PAD)).alias("attention_mask"))


@query("make_labels", f"""WITH {SQL_CHAT_FIT}
SELECT conv_id, string_agg(CAST(CASE WHEN lab AND id <> 1 AND conv_id % 5 <> 0 THEN id ELSE -100 END AS VARCHAR), ' ' ORDER BY p) AS labels
FROM fit WHERE p >= 1 GROUP BY conv_id""")
def make_labels(spark, sf):
    rows = _chat_rows(spark, sf).withColumn("instance_mask", F.col("conv_id") % 5 != 0)
    labels = A.shifted_labels(
        F.col("input_ids"), F.col("label_mask"), A.attention(F.col("input_ids"), tokenize.PAD), F.col("instance_mask")
    )
    return rows.select("conv_id", joined_ids(labels).alias("labels"))


@query("render_chat_prompt", """
SELECT conv_id, '<|endoftext|>' || string_agg('<|' || role || E'|>\\n' ||
       CASE WHEN role = 'assistant' AND turn = last_turn THEN '' ELSE text || E'\\n' END, '' ORDER BY turn) AS prompt
FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations) GROUP BY conv_id""")
def render_chat_prompt(spark, sf):
    prompts = tokenize.render_turns(_turns(spark, sf))
    return prompts.select("conv_id", F.col("text").alias("prompt"))


# --- preference pairs ------------------------------------------------------------------


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(pair_id, chosen, rejected) per conversation: its turns up to the last answered question,
    then its own reply or one of the next conversation."""
    turns = _turns(spark, sf)
    other = turns.where("role = 'assistant'").groupBy((F.col("conv_id") - 1).alias("conv_id")).agg(F.min_by("text", "turn").alias("bad"))
    asked = _questions(spark, sf).groupBy("conv_id").agg(F.max("turn").alias("last"), F.max_by("answer", "turn").alias("answer"))
    wanted = asked.join(other, "conv_id")
    prompt = turns.join(wanted, "conv_id").where("turn <= last").groupBy("conv_id", "last", "answer", "bad").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("prompt")
    )

    def messages(reply):
        end = F.array(F.struct(F.lit("assistant").alias("role"), F.col(reply).alias("content")))
        return F.concat(F.transform("prompt", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), end)

    pair_id = F.shiftleft("conv_id", 32) + F.col("last")
    return prompt.select(pair_id.alias("pair_id"), messages("answer").alias("chosen"), messages("bad").alias("rejected"))


SQL_PAIRS = f"""{SQL_QA},
bad AS (SELECT conv_id - 1 AS conv_id, arg_min(text, turn) AS bad FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
px AS (SELECT conv_id * 4294967296 + last AS pair_id, conv_id, last, answer, bad
       FROM (SELECT conv_id, max(turn) AS last, arg_max(answer, turn) AS answer FROM qa GROUP BY conv_id) JOIN bad USING (conv_id)),
pairs AS (
  SELECT pair_id, side, turn, role, text FROM px JOIN conversations USING (conv_id) CROSS JOIN (VALUES ('chosen'), ('rejected')) s(side) WHERE turn <= last
  UNION ALL SELECT pair_id, 'chosen', last + 1, 'assistant', answer FROM px
  UNION ALL SELECT pair_id, 'rejected', last + 1, 'assistant', bad FROM px)"""

SQL_PAIR_TOKENS = f"""vocab AS ({sql_vocab('conversations')}), {SQL_PAIRS}, {sql_chat_flat('pairs', 'pair_id, side')},
cut AS (SELECT pair_id, side, p, id, CASE WHEN lab THEN id ELSE -100 END AS lab FROM flat WHERE p < {PAIR_LEN})"""


def _sides(pairs: DataFrame) -> DataFrame:
    """Wide encoded pairs to one row per side."""
    sides = [
        pairs.select("pair_id", F.lit(s).alias("side"), *[F.col(f"{s}_{c}").alias(c) for c in ("input_ids", "labels", "attention_mask")])
        for s in ("chosen", "rejected")
    ]
    return sides[0].unionByName(sides[1])


def _encoded_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode_preferences(_pairs(spark, sf), chat_vocab(spark, sf), seq_len=PAIR_LEN)


@query("read_preferences", f"""WITH {SQL_PAIRS}
SELECT pair_id, side, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn) - 1 AS pos, role, text AS content FROM pairs""")
def read_preferences(spark, sf):
    path = fresh_path(spark, "pairs") + ".jsonl"
    writers.write_jsonl(_pairs(spark, sf), path)
    pairs = readers.read_preferences(spark, file=path)
    sides = [
        pairs.select("pair_id", F.lit(s).alias("side"), F.posexplode(s).alias("pos", "m")) for s in ("chosen", "rejected")
    ]
    return sides[0].unionByName(sides[1]).select(
        "pair_id", "side", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content"
    )


@query("encode_preferences", f"""WITH {SQL_PAIR_TOKENS}
SELECT pair_id, side, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY p) AS input_ids,
       string_agg(CAST(lab AS VARCHAR), ' ' ORDER BY p) AS labels, count(*) AS n_attended FROM cut GROUP BY pair_id, side""")
def encode_preferences(spark, sf):
    sides = _sides(_encoded_pairs(spark, sf))
    return sides.select(
        "pair_id",
        "side",
        joined_ids(F.col("input_ids")).alias("input_ids"),
        joined_ids(F.col("labels")).alias("labels"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_attended"),
    )


@query("pair_has_labels", f"""WITH {SQL_PAIR_TOKENS},
counted AS (SELECT pair_id, side, sum(CASE WHEN lab <> -100 THEN 1 ELSE 0 END) AS n FROM cut GROUP BY pair_id, side)
SELECT pair_id, CAST(sum(n) FILTER (side = 'chosen') AS BIGINT) AS n_chosen, CAST(sum(n) FILTER (side = 'rejected') AS BIGINT) AS n_rejected
FROM counted GROUP BY pair_id HAVING min(n) > 0""")
def pair_has_labels(spark, sf):
    def labelled(col):
        return F.size(F.filter(col, lambda x: x != A.IGNORED)).cast("bigint")

    kept = quality.pair_has_labels(_encoded_pairs(spark, sf))
    return kept.select("pair_id", labelled("chosen_labels").alias("n_chosen"), labelled("rejected_labels").alias("n_rejected"))


@query("validate_rows", f"""WITH {SQL_CHAT_FIT}, {SQL_PAIRS},
bad_len AS (SELECT conv_id, count(*) AS n FROM flat GROUP BY conv_id),
shapes AS (SELECT conv_id // 8 AS batch, count(DISTINCT conv_id % 10 = 1) AS n FROM rows_ GROUP BY 1)
SELECT 'ids_and_mask_equally_long' AS rule, count(*) FILTER (conv_id % 10 < 2) AS n_violations FROM rows_
UNION ALL SELECT 'row_has_fixed_length', count(*) FILTER (conv_id % 10 = 1) FROM rows_
UNION ALL SELECT 'fits_before_cutting', CAST(count(*) FILTER (n > 256) AS BIGINT) FROM bad_len
UNION ALL SELECT 'has_a_label', CAST(count(*) FILTER (n_labels = 0) AS BIGINT) FROM rows_
UNION ALL SELECT 'batch_has_one_shape', count(*) FILTER (n > 1) FROM shapes
UNION ALL SELECT 'chosen_not_empty', count(*) FILTER (conv_id % 7 = 0) FROM px
UNION ALL SELECT 'rejected_not_empty', count(*) FILTER (conv_id % 7 = 1) FROM px
UNION ALL SELECT 'not_prompt_and_messages', count(*) FILTER (conv_id % 7 = 2) FROM px""")
def validate_rows(spark, sf):
    """Rows broken in known places, so that every rule has something to find."""
    vocab = chat_vocab(spark, sf)
    encoded = tokenize.chat_encode(_turns(spark, sf), vocab, seq_len=CHAT_LEN)
    lengths = tokenize.chat_lengths(_turns(spark, sf), vocab)
    rows = tokenize.fit_to_length(encoded, CHAT_LEN).join(lengths, "conv_id")
    short = lambda c, last: F.when(F.col("conv_id") % 10 == last, F.slice(c, 1, CHAT_LEN - 1)).otherwise(F.col(c))
    rows = stage(rows.withColumns({"label_mask": short("label_mask", 0), "input_ids": short("input_ids", 1)}), "rows")
    on_rows = quality.violations(rows, {
        "ids_and_mask_equally_long": F.size("input_ids") == F.size("label_mask"),
        "row_has_fixed_length": F.size("input_ids") == CHAT_LEN,
        "fits_before_cutting": F.col("n_full") <= 256,
        "has_a_label": F.col("n_labels") > 0,
    })
    batches = rows.groupBy(F.floor(F.col("conv_id") / 8)).agg(F.min(F.size("input_ids")).alias("least"), F.max(F.size("input_ids")).alias("most"))
    on_batches = quality.violations(batches, {"batch_has_one_shape": F.col("least") == F.col("most")})
    kind = F.shiftright("pair_id", 32) % 7
    none = lambda c, k: F.when(kind == k, F.slice(c, 1, 0)).otherwise(F.col(c))
    pairs = _pairs(spark, sf).select(
        none("chosen", 0).alias("chosen"), none("rejected", 1).alias("rejected"), F.when(kind == 2, "a prompt").alias("prompt")
    )
    on_pairs = quality.violations(pairs, {
        "chosen_not_empty": F.size("chosen") > 0,
        "rejected_not_empty": F.size("rejected") > 0,
        "not_prompt_and_messages": F.col("prompt").isNull() | (F.size("chosen") == 0),
    })
    return on_rows.unionByName(on_batches).unionByName(on_pairs)


# --- samples of rows -------------------------------------------------------------------


@query("upsample", f"""WITH {SQL_QA}
SELECT conv_id, turn, copy_no, row_number() OVER (ORDER BY {sql_md5(SEED, 'conv_id', 'turn', 'copy_no')}, conv_id, turn, copy_no) - 1 AS position
FROM qa CROSS JOIN (SELECT range AS copy_no FROM range(10))""")
def upsample(spark, sf):
    rows = _questions(spark, sf).select("conv_id", "turn")
    return ordering.upsample(rows, ["conv_id", "turn"], 10, SEED)


@query("limit_samples", f"""WITH {SQL_QA} SELECT conv_id, turn, question FROM qa ORDER BY conv_id, turn LIMIT 100""")
def limit_samples(spark, sf):
    return ordering.limit_samples(_questions(spark, sf).select("conv_id", "turn", "question"), ["conv_id", "turn"], 100)


@query("preview_sample", f"""WITH {SQL_QA}
SELECT conv_id, turn, question, answer FROM qa ORDER BY {sql_md5(SEED, 'conv_id', 'turn')}, conv_id, turn LIMIT 3""")
def preview_sample(spark, sf):
    return ordering.preview_sample(_questions(spark, sf), ["conv_id", "turn"], 3, SEED)
