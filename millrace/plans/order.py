"""Queries over the data order: permutation, ranks, workers, batches, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions import arrays as A
from millrace.operators import ordering, packing, placing, tokenize
from millrace.operators.prefix import dense_position
from millrace.plans.layout import _manifest
from millrace.plans.registry import query, table
from millrace.plans.shared import CHAT_LEN, CHUNK, SEED, SQL_CHAT_FLAT, SQL_CHUNKS, chat_vocab, encoded_documents, joined_ids, sql_md5
from millrace.session import fresh_path
from millrace.sources import writers

WORLD, BATCH, WORKERS, MICRO = 7, 16, 3, 6
MAX_EXAMPLES = 1400
STATE = ordering.RunState(examples_seen=35, tokens_seen=35 * 128, fast_forward_batches=2, global_batch=7)
START = STATE.resume()[0]


def _instances(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("instance_id"))


def _size(spark: SparkSession, sf: str) -> Column:
    return _instances(spark, sf).agg(F.count(F.lit(1))).scalar()


def _order(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.seeded_order(_instances(spark, sf), SEED)


SQL_ORDER = f"""
ord AS (SELECT row_number() OVER (ORDER BY {sql_md5(SEED, 'o_orderkey')}, o_orderkey) - 1 AS position, o_orderkey AS instance_id FROM orders)"""


@query("seeded_order", f"WITH {SQL_ORDER} SELECT position, instance_id FROM ord")
def seeded_order(spark, sf):
    return _order(spark, sf).select("position", "instance_id")


@query("epoch_reshuffle", f"""
SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5((epoch + {SEED}) || ':' || o_orderkey), o_orderkey) - 1 AS position,
       o_orderkey AS instance_id FROM orders CROSS JOIN (SELECT range AS epoch FROM range(3))""")
def epoch_reshuffle(spark, sf):
    return ordering.epoch_orders(_instances(spark, sf), SEED, 3).select("epoch", "position", "instance_id")


@query("even_world", f"""WITH {SQL_ORDER}, n AS (SELECT count(*) AS n FROM ord)
SELECT 'cut' AS mode, position, instance_id FROM ord CROSS JOIN n WHERE position < n - n % {WORLD}
UNION ALL SELECT 'padded', p, instance_id FROM n CROSS JOIN LATERAL (SELECT unnest(range(CAST(ceil(n / {WORLD}.0) AS BIGINT) * {WORLD})) AS p)
  JOIN ord ON ord.position = p % n""")
def even_world(spark, sf):
    order = _order(spark, sf)
    n = _size(spark, sf)
    cut = ordering.even_world(order, WORLD, drop_last=True, size=n).withColumn("mode", F.lit("cut"))
    padded = ordering.even_world(order, WORLD, drop_last=False, size=n).withColumn("mode", F.lit("padded"))
    return cut.unionByName(padded).select("mode", "position", "instance_id")


SQL_SLICED = f"{SQL_ORDER}, sliced AS (SELECT * FROM ord WHERE position < {MAX_EXAMPLES} AND position >= {START})"


def _sliced(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.slice_order(_order(spark, sf), WORLD, MAX_EXAMPLES, START)


@query("slice_order", f"WITH {SQL_SLICED} SELECT position, instance_id FROM sliced")
def slice_order(spark, sf):
    return _sliced(spark, sf).select("position", "instance_id")


SQL_EVEN = f"""{SQL_ORDER}, cutto AS (SELECT count(*) - count(*) % {WORLD} AS n FROM ord),
ranked AS (SELECT position, instance_id, n, (position - {START}) % {WORLD} AS rank, (position - {START}) // {WORLD} AS local
           FROM ord CROSS JOIN cutto WHERE position < n AND position >= {START})"""


def _even(spark: SparkSession, sf: str) -> DataFrame:
    """The whole order, cut to the world size and resumed at START."""
    cut = ordering.even_world(_order(spark, sf), WORLD, drop_last=True, size=_size(spark, sf))
    return ordering.rank_stripe(ordering.slice_order(cut, WORLD, None, START), WORLD, START)


@query("rank_stripe", f"WITH {SQL_EVEN} SELECT rank, local, position, instance_id FROM ranked")
def rank_stripe(spark, sf):
    return _even(spark, sf).select("rank", "local", "position", "instance_id")


@query("worker_stripe", f"""WITH {SQL_EVEN},
size AS (SELECT rank, count(*) AS m FROM ranked GROUP BY rank),
w AS (SELECT rank, local, instance_id, CASE WHEN local >= m // {BATCH} * {BATCH} THEN 1 ELSE 0 END AS is_left,
             CASE WHEN local >= m // {BATCH} * {BATCH} THEN (local - m // {BATCH} * {BATCH}) % {WORKERS} ELSE local // {BATCH} % {WORKERS} END AS worker
      FROM ranked JOIN size USING (rank))
SELECT rank, worker, row_number() OVER (PARTITION BY rank, worker ORDER BY is_left, local) - 1 AS worker_seq, instance_id FROM w""")
def worker_stripe(spark, sf):
    striped = _even(spark, sf)
    n = _size(spark, sf)
    total = n - n % WORLD
    shared = ordering.worker_stripe(striped, WORLD, START, BATCH, WORKERS, total)
    return shared.select("rank", "worker", "worker_seq", "instance_id")


@query("interleave_round_robin", """
WITH t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents)
SELECT source, doc_id, row_number() OVER (ORDER BY turn, source) - 1 AS position FROM t""")
def interleave(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id")
    return ordering.interleave_round_robin(docs, "source", "doc_id").select("source", "doc_id", "position")


def _batched(spark: SparkSession, sf: str) -> DataFrame:
    """Chat rows of their own length, in conversation order, eight to a batch."""
    rows = tokenize.chat_encode(table(spark, sf, "conversations"), chat_vocab(spark, sf), seq_len=CHAT_LEN)
    cut = rows.select(
        "conv_id",
        A.truncate(F.col("input_ids"), CHAT_LEN).alias("input_ids"),
        A.truncate(F.col("label_mask"), CHAT_LEN).alias("label_mask"),
    ).withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1)))
    placed = dense_position(cut, "conv_id", out="instance_id")
    return placed.withColumn("batch", F.floor(F.col("instance_id") / 8).cast("bigint"))


@query("collate_batches", f"""WITH {SQL_CHAT_FLAT},
b AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS instance_id FROM (SELECT DISTINCT conv_id FROM conversations)),
lens AS (SELECT b.conv_id, b.instance_id, b.instance_id // 8 AS batch, count(*) AS n FROM b JOIN flat f ON f.conv_id = b.conv_id WHERE p < {CHAT_LEN} GROUP BY ALL),
mx AS (SELECT *, max(n) OVER (PARTITION BY batch) AS m FROM lens),
grid AS (SELECT side, batch, instance_id, m, q, f.id, f.lab FROM mx CROSS JOIN (VALUES ('left'), ('right')) s(side)
         CROSS JOIN LATERAL (SELECT unnest(range(m)) AS q)
         LEFT JOIN flat f ON f.conv_id = mx.conv_id AND f.p < {CHAT_LEN} AND f.p = CASE side WHEN 'right' THEN q ELSE q - (m - n) END)
SELECT side, batch, instance_id, m AS max_len, string_agg(CAST(coalesce(id, 1) AS VARCHAR), ' ' ORDER BY q) AS input_ids,
       string_agg(CASE WHEN lab THEN '1' ELSE '0' END, ' ' ORDER BY q) AS label_mask,
       string_agg(CASE WHEN id IS NULL THEN '0' ELSE '1' END, ' ' ORDER BY q) AS attention_mask
FROM grid GROUP BY side, batch, instance_id, m""")
def collate_batches(spark, sf):
    rows = _batched(spark, sf)
    out = None
    for side in ("left", "right"):
        batches = ordering.collate_batches(rows, ["batch"], "instance_id", tokenize.PAD, side)
        fields = ["instance_id", "input_ids", "label_mask", "attention_mask"]
        zipped = batches.select("batch", "max_len", F.explode(F.arrays_zip(*fields)).alias("r"))
        one = zipped.select(
            F.lit(side).alias("side"), "batch", "max_len", "r.instance_id",
            *[joined_ids(F.col(f"r.{f}")).alias(f) for f in fields[1:]],
        )
        out = one if out is None else out.unionByName(one)
    return out


def _device_batches(spark: SparkSession, sf: str) -> DataFrame:
    return _even(spark, sf).select(
        "rank", F.floor(F.col("local") / BATCH).cast("bigint").alias("step"),
        (F.col("local") % BATCH).alias("pos"), "instance_id",
    )


SQL_BATCHED = f"{SQL_EVEN}, dev AS (SELECT rank, local // {BATCH} AS step, local % {BATCH} AS pos, instance_id FROM ranked)"


@query("microbatches", f"WITH {SQL_BATCHED} SELECT rank, step, pos, pos // {MICRO} AS micro, instance_id FROM dev")
def microbatches(spark, sf):
    return ordering.microbatches(_device_batches(spark, sf), MICRO).select("rank", "step", "pos", "micro", "instance_id")


@query("cap_batches", f"""WITH {SQL_BATCHED}
SELECT 'default' AS evaluator, rank, step, pos, instance_id FROM dev WHERE step < 10
UNION ALL SELECT 'override', rank, step, pos, instance_id FROM dev WHERE step < 3
UNION ALL SELECT 'all', rank, step, pos, instance_id FROM dev""")
def cap_batches(spark, sf):
    batches = _device_batches(spark, sf)
    out = None
    for name, override in (("default", None), ("override", 3), ("all", -1)):
        one = ordering.cap_batches(batches, "step", 10, override).withColumn("evaluator", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("evaluator", "rank", "step", "pos", "instance_id")


@query("progress_counters", """
SELECT event_id, event_id // 2500 AS epoch, row_number() OVER (ORDER BY event_id) AS global_step,
       row_number() OVER (PARTITION BY event_id // 2500 ORDER BY event_id) * 112 AS examples_this_epoch,
       row_number() OVER (ORDER BY event_id) * 112 * 128 AS tokens FROM events""")
def progress_counters(spark, sf):
    steps = table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 2500).cast("bigint").alias("epoch"))
    counted = ordering.progress_counters(steps, batch=112, seq_len=128, step="event_id")
    return counted.select("event_id", "epoch", "global_step", "examples_this_epoch", "tokens")


@query("prompt_batches", """
SELECT o_orderkey AS prompt_id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch_no FROM orders""")
def prompt_batches(spark, sf):
    prompts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("prompt_id"))
    return ordering.prompt_batches(prompts, "prompt_id").select("prompt_id", "batch_no")


@query("write_data_order", f"WITH {SQL_ORDER} SELECT position, instance_id FROM ord")
def write_data_order(spark, sf):
    path = fresh_path(spark, "order")
    writers.write_data_order(_order(spark, sf), path)
    return spark.read.parquet(path)


@query("write_index_trace", f"""WITH {SQL_BATCHED}
SELECT rank, step || E'\\t' || string_agg(CAST(instance_id AS VARCHAR), E'\\t' ORDER BY pos) AS line FROM dev GROUP BY rank, step""")
def write_index_trace(spark, sf):
    path = fresh_path(spark, "trace")
    writers.write_index_trace(_device_batches(spark, sf), path)
    return spark.read.schema("value string, rank bigint").text(path).select("rank", F.col("value").alias("line"))


@query("trace_lookup", f"""WITH {SQL_CHUNKS},
o2 AS (SELECT row_number() OVER (ORDER BY {sql_md5(SEED, 'instance_id')}, instance_id) - 1 AS position, instance_id FROM chunks)
SELECT position % {WORLD} AS rank, position // {WORLD} // {BATCH} AS step, position // {WORLD} % {BATCH} AS pos,
       instance_id, shard_id AS path, chunk AS local_index FROM o2 JOIN chunks USING (instance_id)""")
def trace_lookup(spark, sf):
    manifest = _manifest(spark, sf)
    every = packing.instance_ids(manifest)
    striped = ordering.rank_stripe(ordering.seeded_order(every, SEED), WORLD)
    used = striped.select(
        "rank", F.floor(F.col("local") / BATCH).cast("bigint").alias("step"),
        (F.col("local") % BATCH).alias("pos"), "instance_id",
    )
    path = fresh_path(spark, "trace")
    writers.write_index_trace(used, path)
    back = writers.read_index_trace(spark, path)
    return packing.locate_instance(back, manifest, "instance_id").select(
        "rank", "step", "pos", "instance_id", "path", "local_index"
    )


@query("rank_batches", f"""WITH {SQL_CHUNKS},
o2 AS (SELECT row_number() OVER (ORDER BY {sql_md5(SEED, 'instance_id')}, instance_id) - 1 AS position, count(*) OVER () AS n, instance_id, input_ids FROM chunks)
SELECT position % {WORLD} AS rank, position // {WORLD} // {BATCH} AS step, count(*) AS n_instances,
       string_agg(CAST(instance_id AS VARCHAR), ' ' ORDER BY position) AS instance_ids, md5(string_agg(input_ids, ' ' ORDER BY position)) AS ids_md5
FROM o2 WHERE position < n - n % {WORLD} GROUP BY ALL""")
def rank_batches(spark, sf):
    """Documents to the collated batches of every rank in one plan."""
    batches = placing.rank_batches(encoded_documents(spark, sf), CHUNK, WORLD, BATCH, SEED)
    return batches.select(
        "rank", "step", F.size("instance_ids").cast("bigint").alias("n_instances"),
        F.array_join(F.col("instance_ids").cast("array<string>"), " ").alias("instance_ids"),
        F.md5(joined_ids(F.flatten("input_ids"))).alias("ids_md5"),
    )


EPOCHS = 2


def _sql_turns(n: str) -> str:
    """One pass of the permutation over (key, epoch, x): the halves a and b move by a seeded md5 of each other."""
    said = lambda number, half: f"CAST('0x' || substr(md5('{SEED}:' || epoch || ':{number}:' || {half}), 1, 8) AS BIGINT)"
    out = f"(SELECT * EXCLUDE (x), CAST(x // w AS BIGINT) AS a, CAST(x % w AS BIGINT) AS b FROM {n})"
    for number in range(placing.ROUNDS):
        half = f"* REPLACE ((a + {said(number, 'b')}) % h AS a)" if number % 2 == 0 else f"* REPLACE ((b + {said(number, 'a')}) % w AS b)"
        out = f"(SELECT {half} FROM {out})"
    return out


@query("batch_instances", f"""WITH RECURSIVE size AS (SELECT count(*) AS n FROM orders),
box AS (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS h, CAST(ceil(n / (floor(sqrt(n - 1)) + 1)) AS BIGINT) AS w FROM size),
places AS (SELECT epoch, p, p % {WORLD} AS rank, p // {WORLD} // {BATCH} AS step, p // {WORLD} % {BATCH} AS place, n, h, w, p AS x
           FROM box CROSS JOIN LATERAL (SELECT unnest(range(n - n % {WORLD})) AS p) CROSS JOIN (SELECT range AS epoch FROM range({EPOCHS}))),
walk AS (SELECT * EXCLUDE (a, b), a * w + b AS x FROM {_sql_turns('places')}
         UNION ALL SELECT * EXCLUDE (a, b), a * w + b FROM {_sql_turns('(SELECT * FROM walk WHERE x >= n)')})
SELECT epoch, rank, step, place, x AS instance_id FROM walk WHERE x < n""")
def batch_instances(spark, sf):
    """Every batch of some epochs, asked for by (epoch, rank, step) as a run that resumes would."""
    n = _instances(spark, sf).count()
    n_steps = -(-n // WORLD // BATCH) + 1
    steps = spark.range(EPOCHS * WORLD * n_steps).select(
        F.floor(F.col("id") / (WORLD * n_steps)).cast("bigint").alias("epoch"), (F.col("id") % WORLD).alias("rank"),
        F.pmod(F.floor(F.col("id") / WORLD), F.lit(n_steps)).cast("bigint").alias("step"),
    )
    return placing.batch_instances(steps, n, WORLD, BATCH, SEED)
