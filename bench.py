"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query is computed in full and its result discarded, so nothing is skipped or collected.
Names as arguments choose queries; --all takes every one that is not among the optional ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sample_by_source", "mixture_report", "shard_by_size", "write_jsonl", "messages_to_text",
    "build_vocab", "encode_documents", "decode_tokens", "count_tokens", "make_labels", "encode_preferences",
    "pack_chunks", "periodic_sequences", "repetition_mask", "locate_instance",
    "seeded_order", "even_world", "worker_stripe", "interleave_round_robin", "collate_batches", "trace_lookup",
    "parse_masking_response", "clean_program", "first_correct_program", "verify_variants", "select_retries",
    "majority_answer", "iterative_rounds",
    "prompt_variants", "expand_requests", "pad_requests", "choice_accuracy", "perplexity_by_label", "instance_loss",
    "sliding_throughput", "running_min_loss", "preference_rewards",
    "chat_encode", "write_token_shards", "fewshot_messages", "program_prompts", "subject_task_prompts", "quota_rounds",
    "stream_run_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))

    from millrace.plans import load_all
    from millrace.session import build_session

    queries, _ = load_all()
    spark = build_session(cores=cpus, spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    names = list(queries) if sys.argv[1:] == ["--all"] else sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # the JVM is up before the clock starts
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
