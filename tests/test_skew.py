"""Queries on tables in which one source, conversation, order or rank holds a third of all rows."""

import os

import duckdb
import oracle_check
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
SKEWED = {
    "documents": "SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'src7' ELSE source END AS source) FROM {t} ORDER BY doc_id",
    "conversations": """
        WITH r AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM {t})
        SELECT CASE WHEN rn % 3 = 0 THEN 5 ELSE conv_id END AS conv_id, CASE WHEN rn % 3 = 0 THEN 5000 + rn ELSE turn END AS turn, role, text
        FROM r ORDER BY 1, 2""",
    "lineitem": "SELECT * REPLACE (CASE WHEN l_partkey % 3 = 0 THEN 77 ELSE l_orderkey END AS l_orderkey) FROM {t}",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 9 ELSE o_custkey END AS o_custkey) FROM {t}",
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 4 ELSE user_id END AS user_id) FROM {t}",
}
NAMES = [
    "shard_by_size", "messages_to_text", "passthrough_messages", "chat_encode", "fit_to_length", "render_chat_prompt",
    "encode_preferences", "pack_chunks", "locate_instance", "interleave_round_robin", "collate_batches",
    "first_correct_program", "select_retries", "merge_retries", "majority_answer", "generation_quota", "prompt_variants",
    "sliding_throughput", "running_min_loss", "stream_run_metrics",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    for name in oracle_check.TABLES:
        source = f"read_parquet('{SF}/{name}.parquet')"
        rows = SKEWED.get(name, "SELECT * FROM {t}").format(t=source)
        duckdb.sql(f"COPY ({rows}) TO '{os.path.join(folder, name)}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys_change_nothing(spark, skewed, name):
    con = oracle_check.connect(skewed)
    ok, message = oracle_check.compare(spark, con, name, entry_module.queries()[name], entry_module.oracle_sql()[name], skewed)
    assert ok, message
