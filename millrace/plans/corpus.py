"""Queries over raw documents: reading, writing, shaping, sampling and mixing."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.hashing import seeded_unit
from millrace.functions.text import words
from millrace.operators import mixture, normalize
from millrace.operators.normalize import assign_ids
from millrace.plans.registry import query, spread_table, table, text_literal
from millrace.plans.shared import SEED, sql_md5, sql_strip, sql_unit, sql_words
from millrace.session import fresh_path, stage
from millrace.sources import manifests, readers, writers, zstd_lines

SHARD_BYTES = 40_000
FRACTIONS = {"src0": 0.5, "src1": 0.0323, "src2": 0.053, "src3": 0.5, "src4": 0.25}


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


# --- sources and sinks -----------------------------------------------------------------


@query("read_documents", "SELECT CAST(doc_id AS VARCHAR) AS id, text, source FROM documents")
def read_documents(spark, sf):
    path = fresh_path(spark, "documents")
    docs = spread_table(spark, sf, "documents", "doc_id", "text", "source")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text", "source", writers.folder_of("source").alias("folder"))
    # the record keeps its source, whatever its folder is called
    writers.write_jsonl(rows, path, partition_by=["folder"])
    return readers.read_documents(spark, [f"{path}/folder=*/*.json.gz"])


@query("read_zstd_documents", "SELECT CAST(doc_id AS VARCHAR) AS id, text, source FROM documents")
def read_zstd_documents(spark, sf):
    path = fresh_path(spark, "zstd-documents")
    docs = spread_table(spark, sf, "documents", "doc_id", "text", "source")
    record = F.struct(F.col("doc_id").cast("string").alias("id"), "text", "source")
    zstd_lines.write_lines(docs.select(F.to_json(record).alias("value")), path)
    return readers.read_documents(spark, [f"{path}/*.jsonl.zst"])


@query("load_corpus", """
SELECT lang, CASE WHEN source = 'src0' THEN 'validation' ELSE 'train' END AS split,
       count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM documents GROUP BY ALL""")
def load_corpus(spark, sf):
    documents = readers.Corpus(
        path=f"{sf}/documents.parquet",
        splits={"validation": F.col("source") == "src0", "train": F.lit(True)},
    )
    named = replace(documents, convert=lambda rows: rows.select("lang", documents.split_name().alias("split"), F.length("text").alias("n")))
    return readers.load_corpus(spark, {"documents": named}, "documents").groupBy("lang", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n").cast("bigint").alias("n_chars")
    )


@query("percent_fold", """
WITH placed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST(list_sum(list_transform(range(1, 10),
         lambda k: CASE WHEN p >= round_even(n * (10 * k) / 100.0, 0) THEN 1 ELSE 0 END)) AS BIGINT) AS fold
FROM placed""")
def percent_fold(spark, sf):
    return readers.with_folds(_docs(spark, sf).select("doc_id"), "doc_id")


@query("write_jsonl", """
SELECT 'documents-' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS id, text, 'documents' AS source
FROM documents""")
def write_jsonl(spark, sf):
    path = fresh_path(spark, "jsonl")
    rows = readers.stored_position(spark, f"{sf}/documents.parquet", ["text"])
    named = rows.select(
        F.concat(F.lit("documents-"), F.col("position").cast("string")).alias("id"), "text", F.lit("documents").alias("source")
    )
    writers.write_jsonl(named, path)
    return readers.read_documents(spark, [path])


def _sharded(spark: SparkSession, sf: str) -> DataFrame:
    # sizes are taken where the text is read; the text itself goes no further
    docs = spread_table(spark, sf, "documents", "doc_id", "source", "text")
    sized = docs.select("doc_id", "source", F.octet_length("text").alias("n_bytes"), F.size(words("text")).alias("n_tokens"))
    return writers.shard_by_size(sized, "doc_id", F.col("n_bytes"), SHARD_BYTES)


SQL_SHARDED = f"""
sharded AS (
  SELECT doc_id, source, text, octet_length(encode(text)) AS n_bytes,
         CAST(floor((sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id)
              - octet_length(encode(text))) / {SHARD_BYTES}) AS BIGINT) AS shard
  FROM documents)"""


@query("shard_by_size", f"WITH {SQL_SHARDED} SELECT doc_id, source, shard FROM sharded")
def shard_by_size(spark, sf):
    return _sharded(spark, sf).select("doc_id", "source", "shard")


@query("write_size_shards", f"""WITH {SQL_SHARDED}
SELECT source, shard, count(*) AS n_docs, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, min(doc_id) AS first_doc, max(doc_id) AS last_doc,
       md5(string_agg(md5(text), '' ORDER BY doc_id)) AS texts_md5 FROM sharded GROUP BY source, shard""")
def write_size_shards(spark, sf):
    """One row per file written, told from what is in it."""
    path = fresh_path(spark, "size-shards")
    docs = spread_table(spark, sf, "documents", "doc_id", "source", "text")
    writers.write_size_shards(docs, path, "doc_id", F.octet_length("text"), SHARD_BYTES)
    back = spark.read.schema("doc_id bigint, source string, text string, shard bigint").json(path)
    rows = back.select("doc_id", "source", "shard", F.col("_metadata.file_path").alias("file"), F.octet_length("text").alias("n"), F.md5("text").alias("h"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda x: x["h"]), "")
    return rows.groupBy("file", "source", "shard").agg(  # a file is bounded by the limit
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("bigint").alias("n_bytes"), F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"), F.md5(texts).alias("texts_md5"),
    ).drop("file")


@query("stage_checkpoint", """
WITH stages AS (
  SELECT o_orderkey AS case_id, 1 AS stage, 0 AS round, 'masked ' || o_orderpriority AS payload FROM orders
  UNION ALL SELECT o_orderkey, 2, 1, 'program ' || o_orderstatus FROM orders WHERE o_orderstatus <> 'O'
  UNION ALL SELECT o_orderkey, 2, 2, 'program again ' || o_orderstatus FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 3, 1, 'executed' FROM orders WHERE o_orderstatus = 'F')
SELECT case_id, CAST(stage AS BIGINT) AS stage, CAST(round AS BIGINT) AS round, payload FROM stages
QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY stage DESC, round DESC) = 1""")
def stage_checkpoint(spark, sf):
    orders = table(spark, sf, "orders")

    def rows(where, stage_no, round_no, payload):
        return orders.where(where).select(
            F.col("o_orderkey").alias("case_id"),
            F.lit(stage_no).cast("bigint").alias("stage"),
            F.lit(round_no).cast("bigint").alias("round"),
            payload.alias("payload"),
        )

    status = F.col("o_orderstatus")
    parts = [
        rows(F.lit(True), 1, 0, F.concat(F.lit("masked "), F.col("o_orderpriority"))),
        rows(status != "O", 2, 1, F.concat(F.lit("program "), status)),
        rows(status == "P", 2, 2, F.concat(F.lit("program again "), status)),
        rows(status == "F", 3, 1, F.lit("executed")),
    ]
    written = [stage(p, "cases") for p in parts]
    every = written[0]
    for part in written[1:]:
        every = every.unionByName(part)
    return writers.furthest_stage(every)


@query("prefer_longer", """
SELECT o_orderkey AS case_id, CASE WHEN (SELECT count(*) FILTER (o_orderstatus = 'F') < count(*) FROM orders) THEN 'earlier' ELSE 'later' END AS payload
FROM orders WHERE (SELECT count(*) FILTER (o_orderstatus = 'F') < count(*) FROM orders) OR o_orderstatus = 'F'""")
def prefer_longer(spark, sf):
    """A later stage that lost cases does not take the earlier one's place."""
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderstatus")
    earlier = cases.select("case_id", F.lit("earlier").alias("payload"))
    later = cases.where("o_orderstatus = 'F'").select("case_id", F.lit("later").alias("payload"))
    return writers.prefer_longer(earlier, later)


# --- projections -----------------------------------------------------------------------


@query("remap_roles", "SELECT conv_id, turn, role, text AS content FROM conversations")
def remap_roles(spark, sf):
    foreign = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.struct(foreign.alias("from"), F.col("text").alias("value")).alias("m")
    )
    # one array per turn keeps the records long; the mapping itself is the same for any length
    records = turns.select("conv_id", "turn", F.array("m").alias("conversations"))
    return normalize.remap_roles(records).select("conv_id", "turn", F.inline("messages"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it directly."""
    turns = table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(told, ["conv_id", "turn"])


SQL_QA = """
qa AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
       FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
       WHERE u.role = 'user' AND a.role = 'assistant')"""


@query("qa_to_messages", f"""WITH {SQL_QA}
SELECT conv_id, turn, CAST(0 AS BIGINT) AS pos, 'user' AS role, question AS content FROM qa
UNION ALL SELECT conv_id, turn, 1, 'assistant', answer FROM qa""")
def qa_to_messages(spark, sf):
    records = normalize.qa_to_messages(_questions(spark, sf))
    return records.select("conv_id", "turn", F.posexplode("messages").alias("pos", "m")).select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content"
    )


@query("cut_at_delimiter", """
WITH c AS (SELECT doc_id, text || E'\\n#### ' || source || E'\\n#### ' || lang AS t FROM documents)
SELECT doc_id, substr(t, 1, instr(t, E'\\n####') - 1) AS content FROM c""")
def cut_at_delimiter(spark, sf):
    cot = F.concat(F.col("text"), F.lit("\n#### "), F.col("source"), F.lit("\n#### "), F.col("lang"))
    return _docs(spark, sf).select("doc_id", normalize.cut_at_delimiter(cot).alias("content"))


def _multiple_choice(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, question, choices, answer): choice k is the text of item id + 7k, modulo the count."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    total = items.agg(F.count(F.lit(1))).scalar()
    wanted = items.select(
        "item_id", F.col("text").alias("question"), F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k")
    ).withColumn("other", (F.col("item_id") + 7 * F.col("k")) % total)
    named = wanted.join(items.select(F.col("item_id").alias("other"), F.col("text").alias("choice")), "other")
    return named.groupBy("item_id", "question").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "choice"))), lambda x: x["choice"]).alias("choices")
    ).withColumn("answer", (F.col("item_id") % 4).cast("int"))


SQL_MC = """
mc AS (SELECT b.item_id, b.text AS question, list(o.text ORDER BY k) AS choices, b.item_id % 4 AS answer
       FROM benchmark b CROSS JOIN (SELECT range AS k FROM range(4)) CROSS JOIN (SELECT count(*) AS n FROM benchmark)
       JOIN benchmark o ON o.item_id = (b.item_id + 7 * k) % n
       GROUP BY b.item_id, b.text)"""


@query("mc_to_chat", f"""
WITH {SQL_MC},
tmpl AS (SELECT * FROM (VALUES {", ".join(f"({i}, {text_literal(q)}, {text_literal(a)})" for i, (q, a) in enumerate(normalize.CHOICE_TEMPLATES))}) AS t(no, intro, reply)),
pairs AS (SELECT item_id, question, choices, answer, i, choices[i + 1] AS c, {sql_md5(SEED, 'item_id', 'i')} AS h
          FROM mc CROSS JOIN (SELECT range AS i FROM range(4))),
mixed AS (SELECT item_id, question, choices[CAST(answer AS INTEGER) + 1] AS correct, list(c ORDER BY h, i) AS o
          FROM pairs GROUP BY item_id, question, choices, answer),
lettered AS (SELECT *, substr('ABCD', CAST(list_position(o, correct) AS INTEGER), 1) AS letter,
                    CAST('0x' || substr({sql_md5(SEED, "'wording'", 'item_id')}, 1, 8) AS BIGINT) % 11 AS no FROM mixed)
SELECT item_id,
       intro || 'Question: ' || question || E'\\nA. ' || o[1] || E'\\nB. ' || o[2] || E'\\nC. ' || o[3] || E'\\nD. ' || o[4] AS question_text,
       replace(reply, '{{answer}}', letter) AS answer_text
FROM lettered JOIN tmpl USING (no)""")
def mc_to_chat(spark, sf):
    rows = normalize.mc_to_chat(_multiple_choice(spark, sf), SEED, "item_id", "question", "choices", "answer")
    return rows.select("item_id", "question_text", "answer_text")


@query("assign_ids", """
SELECT doc_id, 'corpus_' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS id FROM documents""")
def assign_dense_ids(spark, sf):
    return assign_ids(_docs(spark, sf).select("doc_id"), "corpus", "doc_id")


@query("messages_to_text", f"""
SELECT conv_id, string_agg({sql_strip('text')} || E'\\n', '' ORDER BY turn) AS text FROM conversations GROUP BY ALL""")
def messages_to_text(spark, sf):
    return normalize.turns_to_text(table(spark, sf, "conversations"))


@query("passthrough_messages", """
WITH ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS i FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT 'chat' AS dataset, 'chat_' || CAST(i AS VARCHAR) AS id,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text AS content
FROM conversations JOIN ids USING (conv_id)""")
def passthrough_messages(spark, sf):
    tagged = normalize.passthrough_messages(table(spark, sf, "conversations"), "chat")
    return tagged.select("dataset", "id", "pos", "role", F.col("text").alias("content"))


@query("prune_columns", "SELECT doc_id, source, n_chars FROM documents")
def prune_columns(spark, sf):
    return normalize.prune_columns(_docs(spark, sf), ["doc_id", "source", "n_chars"])


@query("attach_metadata", """
SELECT doc_id, 'label' AS meta_key, 'lang-' || lang AS meta_value FROM documents""")
def attach_metadata(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "lang", F.concat_ws("/", "lang", "source").alias("path"))
    manifest = stage(manifests.manifest_of(docs, "path", F.concat(F.lit("lang-"), F.col("lang"))), "manifest")
    tagged = manifests.attach_metadata(docs, manifest)
    return tagged.select("doc_id", F.explode("metadata").alias("meta_key", "meta_value"))


# --- mixtures --------------------------------------------------------------------------


@query("sample_by_source", f"""
WITH f AS (SELECT * FROM (VALUES {", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in FRACTIONS.items())}) AS t(source, fraction))
SELECT d.doc_id, d.source FROM documents d LEFT JOIN f USING (source)
WHERE {sql_unit(SEED, 'doc_id')} < coalesce(fraction, 1.0)""")
def sample_by_source(spark, sf):
    return mixture.sample_by_source(_docs(spark, sf).select("doc_id", "source"), FRACTIONS, "doc_id", SEED)


@query("select_shards", f"""WITH {SQL_SHARDED},
listed AS (SELECT source, shard FROM sharded GROUP BY source, shard HAVING {sql_unit(SEED, 'source', 'shard')} < 0.25)
SELECT source, shard, count(*) AS n_documents, CAST(sum(n_bytes) AS BIGINT) AS n_bytes
FROM sharded SEMI JOIN listed USING (source, shard) GROUP BY source, shard""")
def select_shards(spark, sf):
    sharded = _sharded(spark, sf).select("source", "shard", "n_bytes")
    listed = stage(sharded.select("source", "shard").distinct().where(seeded_unit(SEED, "source", "shard") < 0.25), "listed")
    return mixture.select_shards(sharded, listed).groupBy("source", "shard").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n_bytes").cast("bigint").alias("n_bytes")
    )


MIXER = ["de", 0.5, "en", 1.0, "es", 40, "fr", 30]


@query("mix_datasets", f"""
SELECT doc_id, lang FROM documents WHERE lang = 'en' OR (lang = 'de' AND {sql_unit(SEED, 'doc_id')} < 0.5)
UNION ALL SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sql_md5(SEED, 'doc_id')}, doc_id) AS rn
  FROM documents WHERE lang IN ('es', 'fr')) WHERE rn <= CASE lang WHEN 'es' THEN 40 ELSE 30 END""")
def mix_datasets(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "lang")
    amounts = mixture.parse_mixer_list(MIXER)
    parts = {lang: docs.where(F.col("lang") == lang) for lang in amounts}
    return mixture.mix_datasets(parts, amounts, "doc_id", SEED, ["doc_id", "lang"])


@query("mixture_report", f"""WITH {SQL_SHARDED},
per AS (SELECT source, count(DISTINCT shard) AS files, count(*) AS documents,
               CAST(sum(len({sql_words('text')})) AS BIGINT) AS tokens FROM sharded GROUP BY source)
SELECT source, files, documents, tokens, round(documents / CAST(sum(documents) OVER () AS DOUBLE), 9) AS document_share,
       round(tokens / CAST(sum(tokens) OVER () AS DOUBLE), 9) AS token_share FROM per""")
def mixture_report(spark, sf):
    return mixture.mixture_report(_sharded(spark, sf), F.col("n_tokens"))


@query("union_sources", """
SELECT 'benchmark' AS label, CAST(item_id AS VARCHAR) AS id, text FROM benchmark
UNION ALL SELECT 'conversations', conv_id || '-' || turn, text FROM conversations
UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), text FROM documents""")
def union_sources(spark, sf):
    parts = {
        "documents": _docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "text"),
        "conversations": table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"),
        "benchmark": table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text"),
    }
    return mixture.union_sources(parts).select("label", "id", "text")
