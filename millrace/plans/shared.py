"""Inputs derived from the given tables, in Spark and, for the checks, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators.tokenize import Vocabulary
from millrace.plans.registry import spread_table

SEED = 96
VOCAB = 50280


def joined_ids(col: Column) -> Column:
    """An array as one blank separated text, so that every engine compares it alike."""
    return F.array_join(col.cast("array<int>").cast("array<string>"), " ")


def sql_words(col: str) -> str:
    return rf"regexp_extract_all({col}, '[^ \t\n\r]+')"


def sql_vocab(relation: str, col: str = "text", size: int = VOCAB) -> str:
    """CTE body: (w, id, n) of the ranked words."""
    return f"""
  SELECT w, 6 + rn AS id, n FROM (
    SELECT w, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, w) AS rn
    FROM (SELECT unnest({sql_words(col)}) AS w FROM {relation}) GROUP BY w)
  WHERE rn <= {size - 7}"""


EOS_PLACE = 10**15


def sql_word_ids(word: str = "w") -> str:
    """Ids of a word joined to vocab v: its own, or its bytes and the mark after them."""
    byte = f"list_transform(range(strlen({word})), lambda i: 65280 + CAST('0x' || substr(hex({word}), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"(CASE WHEN v.id IS NOT NULL THEN [CAST(v.id AS BIGINT)] ELSE {byte} || [CAST(65279 AS BIGINT)] END)"


def sql_strip(col: str) -> str:
    return rf"regexp_replace(regexp_replace({col}, '^[ \t\n\r\x0b\x0c]+', ''), '[ \t\n\r\x0b\x0c]+$', '')"


def sql_unit(seed: int, *keys: str) -> str:
    """Uniform number of a seeded md5."""
    parts = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST('0x' || substr(md5('{seed}:' || {parts}), 1, 8) AS BIGINT) / 4294967296.0)"


def sql_md5(seed: int | str, *keys: str) -> str:
    parts = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"md5('{seed}:' || {parts})"


FLOAT_RE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def sql_float(col: str) -> str:
    return rf"CASE WHEN regexp_matches({col}, '{FLOAT_RE}') THEN CAST(regexp_replace({col}, '\s', '', 'g') AS DOUBLE) END"


def sql_last_number(col: str) -> str:
    found = rf"regexp_extract_all(coalesce({col}, ''), '[-+]?\d{{1,3}}(?:,\d{{3}})*(?:\.\d+)?')"
    return f"CAST(replace({found}[-1], ',', '') AS DOUBLE)"


# --- chat -----------------------------------------------------------------------------

CHAT_LEN = 4096


def chat_vocab(spark: SparkSession, sf: str) -> Vocabulary:
    return Vocabulary.of(spread_table(spark, sf, "conversations", "text"), size=VOCAB)


def sql_chat_flat(relation: str, keys: str, order: str = "turn") -> str:
    """CTEs split, seg and flat: every token (id, lab) of a chat at its position p."""
    return f"""
split AS (SELECT {keys}, {order}, role, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
          FROM (SELECT {keys}, {order}, role, {sql_words('text')} AS ws FROM {relation})),
seg AS (
  SELECT {keys}, {order}, 0 AS part, 0 AS pos,
         CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 5 WHEN 'system' THEN 6 END AS id, false AS lab FROM {relation}
  UNION ALL SELECT {keys}, {order}, 1, 0, 3, false FROM {relation}
  UNION ALL SELECT {keys}, {order}, 2, pos * 1000000 + generate_subscripts(ids, 1), unnest(ids), role = 'assistant'
            FROM (SELECT {', '.join('split.' + k.strip() for k in keys.split(','))}, split.{order}, pos, role, {sql_word_ids('split.w')} AS ids FROM split LEFT JOIN vocab v USING (w))
  UNION ALL SELECT {keys}, {order}, 3, 0, 0, true FROM {relation} WHERE role = 'assistant'
  UNION ALL SELECT {keys}, {order}, 4, 0, 3, false FROM {relation}),
flat AS (
  SELECT {keys}, id, lab, row_number() OVER (PARTITION BY {keys} ORDER BY {order}, part, pos) AS p FROM seg
  UNION ALL SELECT {keys}, 0, false, 0 FROM (SELECT DISTINCT {keys} FROM {relation}))"""


SQL_CHAT_FLAT = f"vocab AS ({sql_vocab('conversations')}), {sql_chat_flat('conversations', 'conv_id')}"

SQL_CHAT_FIT = f"""{SQL_CHAT_FLAT},
fit AS (
  SELECT c.conv_id, g.p, coalesce(f.id, 1) AS id, coalesce(f.lab, false) AS lab
  FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN (SELECT range AS p FROM range({CHAT_LEN})) g
  LEFT JOIN flat f ON f.conv_id = c.conv_id AND f.p = g.p),
rows_ AS (
  SELECT conv_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY p) AS input_ids,
         string_agg(CAST(CAST(lab AS INTEGER) AS VARCHAR), ' ' ORDER BY p) AS label_mask,
         CAST(sum(CAST(lab AS INTEGER)) AS BIGINT) AS n_labels
  FROM fit GROUP BY conv_id)"""


# --- documents as token chunks ---------------------------------------------------------

CHUNK = 128


def doc_vocab(spark: SparkSession, sf: str) -> Vocabulary:
    return Vocabulary.of(spread_table(spark, sf, "documents", "text"), size=VOCAB)


def encoded_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, input_ids): every document's words and a closing eos.

    Written once, because the layout reads it twice (sizes, then tokens).
    """
    from millrace.operators.tokenize import encode_documents
    from millrace.session import stage

    docs = spread_table(spark, sf, "documents", "doc_id", "source", "text")
    encoded = encode_documents(docs, doc_vocab(spark, sf))
    sized = encoded.select("doc_id", "source", "input_ids", F.size("input_ids").alias("n_tokens"))
    return stage(sized, "encoded")


SQL_DOC_TOKENS = f"""
vocab AS ({sql_vocab('documents')}),
dsplit AS (SELECT doc_id, source, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
           FROM (SELECT doc_id, source, {sql_words('text')} AS ws FROM documents)),
dtok AS (
  SELECT doc_id, source, pos * 1000000 + generate_subscripts(ids, 1) AS pos, unnest(ids) AS id
  FROM (SELECT s.doc_id, s.source, s.pos, {sql_word_ids('s.w')} AS ids FROM dsplit s LEFT JOIN vocab v ON v.w = s.w)
  UNION ALL SELECT doc_id, source, {EOS_PLACE}, 0 FROM documents)"""

SQL_CHUNKS = f"""{SQL_DOC_TOKENS},
stream AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS p FROM dtok),
full_chunks AS (
  SELECT source AS shard_id, CAST(p // {CHUNK} AS BIGINT) AS chunk, count(*) AS n,
         string_agg(CAST(id AS VARCHAR), ' ' ORDER BY p) AS input_ids
  FROM stream GROUP BY source, p // {CHUNK} HAVING count(*) = {CHUNK}),
sizes AS (SELECT shard_id, count(*) AS n_chunks FROM full_chunks GROUP BY shard_id),
offs AS (SELECT shard_id, n_chunks, sum(n_chunks) OVER (ORDER BY shard_id) - n_chunks AS start_,
                sum(n_chunks) OVER (ORDER BY shard_id) AS end_ FROM sizes),
chunks AS (SELECT c.shard_id, c.chunk, c.input_ids, CAST(o.start_ + c.chunk AS BIGINT) AS instance_id
           FROM full_chunks c JOIN offs o USING (shard_id))"""
