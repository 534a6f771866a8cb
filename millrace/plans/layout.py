"""Queries over packed chunks: layout, lookup and repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.functions import arrays as A
from millrace.functions.periods import periodic_sequences
from millrace.operators import packing, quality
from millrace.plans.chat import _chat_rows
from millrace.plans.registry import query, table
from millrace.plans.shared import CHUNK, SQL_CHAT_FIT, SQL_CHUNKS, SQL_DOC_TOKENS, encoded_documents, joined_ids
from millrace.session import fresh_path, stage
from millrace.sources import readers, writers

MAX_COUNT = 8


def _layout(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with instance_id, manifest)."""
    docs = encoded_documents(spark, sf)
    manifest = stage(packing.chunk_manifest(docs, CHUNK), "manifest")
    return packing.number_instances(packing.pack_chunks(docs, CHUNK), manifest), manifest


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Written, so that it is counted once and its true size decides how it is joined."""
    return stage(packing.chunk_manifest(encoded_documents(spark, sf), CHUNK), "manifest")


@query("pack_chunks", f"WITH {SQL_CHUNKS} SELECT shard_id, chunk, input_ids FROM chunks")
def pack_chunks(spark, sf):
    chunks = packing.pack_chunks(encoded_documents(spark, sf), CHUNK)
    return chunks.select("shard_id", "chunk", joined_ids(F.col("input_ids")).alias("input_ids"))


@query("chunk_offsets", f"""WITH {SQL_CHUNKS}
SELECT shard_id AS path, CAST(n_chunks AS BIGINT) AS n_chunks, CAST(start_ AS BIGINT) AS "start", CAST(end_ AS BIGINT) AS "end" FROM offs""")
def chunk_offsets(spark, sf):
    return _manifest(spark, sf).select("path", "n_chunks", "start", "end")


@query("read_token_chunks", f"WITH {SQL_CHUNKS} SELECT shard_id, instance_id, md5(input_ids) AS ids_md5 FROM chunks")
def read_token_chunks(spark, sf):
    path = fresh_path(spark, "chunks")
    chunks, _ = _layout(spark, sf)
    writers.write_token_shards(chunks.select("shard_id", "instance_id", "input_ids"), path, "instance_id", "shard_id")
    back = readers.read_token_chunks(spark, path)
    return back.select("shard_id", "instance_id", F.md5(joined_ids(F.col("input_ids"))).alias("ids_md5"))


@query("locate_instance", f"""WITH {SQL_CHUNKS}, total AS (SELECT max(end_) AS n FROM offs)
SELECT instance_id AS index, shard_id AS path, chunk AS local_index FROM chunks
UNION ALL SELECT CAST(instance_id - n AS BIGINT), shard_id, chunk FROM chunks CROSS JOIN total""")
def locate_instance(spark, sf):
    manifest = _manifest(spark, sf)
    every = packing.instance_ids(manifest, "index")
    negative = every.select((F.col("index") - manifest.agg(F.max("end")).scalar()).alias("index"))
    return packing.locate_instance(every.unionByName(negative), manifest)


@query("concat_datasets", f"""WITH {SQL_CHUNKS},
n AS (SELECT shard_id, n_chunks, sum(n_chunks) OVER (ORDER BY (shard_id < 'src5'), shard_id) - n_chunks AS s FROM offs)
SELECT c.shard_id, c.chunk, CAST(n.s + c.chunk AS BIGINT) AS instance_id FROM chunks c JOIN n USING (shard_id)""")
def concat_datasets(spark, sf):
    docs = encoded_documents(spark, sf)
    late = packing.chunk_manifest(docs.where("source >= 'src5'"), CHUNK)
    early = packing.chunk_manifest(docs.where("source < 'src5'"), CHUNK)

    def numbered(manifest):
        return manifest.withColumn("ordinal", F.row_number().over(Window.orderBy("path")).cast("bigint") - 1)

    both = stage(packing.concat_manifests(numbered(late), numbered(early)), "manifest")
    chunks = packing.number_instances(packing.pack_chunks(docs, CHUNK), both)
    return chunks.select("shard_id", "chunk", "instance_id")


SUBJECTS = [3, 1, 4, 0, 2]


@query("concat_splits", f"""
SELECT item_id, item_id % 5 AS subject, row_number() OVER (ORDER BY list_position({SUBJECTS}, item_id % 5), item_id) - 1 AS position
FROM benchmark""")
def concat_splits(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 5).alias("subject"))
    return packing.concat_splits(items, "subject", SUBJECTS, "item_id").select("item_id", "subject", "position")


def sql_runs(relation: str, key: str) -> str:
    """CTE runs over (key, p, id): maximal stretches of period k from 1 to 13."""
    return f"""
same AS (SELECT a.{key}, a.p, k.k FROM {relation} a CROSS JOIN (SELECT range AS k FROM range(1, 14)) k
         JOIN {relation} b ON b.{key} = a.{key} AND b.p = a.p - k.k AND b.id = a.id),
isl AS (SELECT {key}, k, p, p - row_number() OVER (PARTITION BY {key}, k ORDER BY p) AS g FROM same),
runs AS (SELECT {key}, CAST(min(p) - k AS BIGINT) AS start_, CAST(max(p) + 1 AS BIGINT) AS end_, CAST(k AS BIGINT) AS period,
                CAST((count(*) + k) // k AS BIGINT) AS times FROM isl GROUP BY {key}, k, g HAVING count(*) >= 2 * k)"""


@query("periodic_sequences", f"""WITH {SQL_DOC_TOKENS},
seq AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p FROM dtok), {sql_runs('seq', 'doc_id')}
SELECT doc_id, start_ AS "start", end_ AS "end", period, times FROM runs""")
def periodic(spark, sf):
    docs = encoded_documents(spark, sf)
    return docs.select("doc_id", F.inline(periodic_sequences(F.col("input_ids"))))


@query("repetition_mask", f"""WITH {SQL_CHUNKS},
seq AS (SELECT source || '/' || (p // {CHUNK}) AS k_, id, p % {CHUNK} AS p FROM stream), {sql_runs('seq', 'k_')},
most AS (SELECT k_, max(times) AS times FROM runs GROUP BY k_)
SELECT instance_id, coalesce(times, 0) AS times, CAST(coalesce(times, 0) < {MAX_COUNT} AS INTEGER) AS instance_mask
FROM chunks LEFT JOIN most ON k_ = shard_id || '/' || chunk""")
def repetition_mask(spark, sf):
    chunks, _ = _layout(spark, sf)
    masked = quality.repetition_mask(chunks, max_count=MAX_COUNT)
    return masked.select("instance_id", "times", F.col("instance_mask").cast("int").alias("instance_mask"))


@query("consecutive_groups", """
WITH l AS (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS g FROM (SELECT DISTINCT doc_id FROM labels))
SELECT min(doc_id) AS "first", max(doc_id) AS "last", count(*) AS n FROM l GROUP BY g""")
def consecutive_groups(spark, sf):
    return packing.consecutive_groups(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id")


@query("edge_true_runs", f"""WITH {SQL_CHAT_FIT},
e AS (SELECT conv_id, min(p) FILTER (id = 1) AS first_pad, max(p) FILTER (lab) AS last_lab,
             max(p) FILTER (id <> 1) AS last_token, count(*) AS n FROM fit GROUP BY conv_id)
SELECT conv_id, CAST(coalesce(first_pad, n) AS BIGINT) AS tokens_end,
       CAST(CASE WHEN last_token = n - 1 THEN -1 ELSE last_token + 1 END AS BIGINT) AS padding_start,
       CAST(0 AS BIGINT) AS labels_end,
       CAST(CASE WHEN last_lab IS NULL OR last_lab < n - 1 THEN -1
            ELSE (SELECT max(p) + 1 FROM fit f WHERE f.conv_id = e.conv_id AND NOT f.lab) END AS BIGINT) AS labels_start FROM e""")
def edge_true_runs(spark, sf):
    rows = _chat_rows(spark, sf)
    token = F.transform("input_ids", lambda x: x != 1)
    padding = F.transform("input_ids", lambda x: x == 1)
    return rows.select(
        "conv_id",
        A.leading_run_end(token).alias("tokens_end"),
        A.trailing_run_start(padding).alias("padding_start"),
        A.leading_run_end(F.col("label_mask")).alias("labels_end"),
        A.trailing_run_start(F.col("label_mask")).alias("labels_start"),
    )
