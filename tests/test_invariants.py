"""Properties that must hold whatever the data."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.functions.periods import periodic_sequences
from millrace.operators import mixture, ordering, packing
from millrace.operators.prefix import running_minimum, running_offset, trailing_blocks
from millrace.sources import readers, writers


def test_running_offset_and_minimum_over_levels(spark):
    rng = random.Random(7)
    rows = []
    for g in ("hot", "a", "b"):
        for key in rng.sample(range(-50, 2**45), 600 if g == "hot" else 40) + list(range(2**45, 2**45 + 30)):
            rows.append((g, key, rng.randrange(9), rng.random()))
    df = spark.createDataFrame(rows, "g string, k bigint, w bigint, v double").repartition(5)
    want, low = {}, {}
    for g in ("hot", "a", "b"):
        total, least = 0, float("inf")
        for _, k, w, v in sorted(r for r in rows if r[0] == g):
            want[g, k] = total
            total += w
            least = min(least, v)
            low[g, k] = least
    for shifts in ((16, 40), (3, 8), (44,)):
        got = running_offset(df, "k", F.col("w"), ["g"], shifts=shifts).collect()
        assert {(r["g"], r["k"]): r["offset"] for r in got} == want
        got = running_minimum(df, "k", "v", ["g"], shifts=shifts).collect()
        assert {(r["g"], r["k"]): r["running_min"] for r in got} == low


def test_no_window_runs_in_one_task(spark):
    """The order of data is found without sending all rows to one partition."""
    order = ordering.seeded_order(spark.range(1000).withColumnRenamed("id", "instance_id"), 1)
    plan = order._jdf.queryExecution().executedPlan().toString()
    windows = plan.count("Window [sum(")
    single = plan.count("SinglePartition")
    # the only one-task window is over the 2**16 range totals
    assert windows == 2 and single <= 2


def test_trailing_blocks_are_exact(spark):
    from pyspark.sql import Window

    df = spark.range(1000).select(F.col("id").alias("p"), (F.col("id") * 7 % 13).alias("x"))
    frame = Window.partitionBy("__block").orderBy("p").rowsBetween(-4, 0)
    got = trailing_blocks(df, "p", 5, block=16).withColumn("s", F.sum("x").over(frame)).where(~F.col("__context"))
    want = {i: sum(j * 7 % 13 for j in range(max(0, i - 4), i + 1)) for i in range(1000)}
    assert {r["p"]: r["s"] for r in got.collect()} == want


def test_order_is_a_permutation_and_depends_on_the_seed(spark):
    ids = spark.range(500).withColumnRenamed("id", "instance_id")
    a, b = (ordering.seeded_order(ids.repartition(n), 5).orderBy("position").collect() for n in (1, 7))
    assert a == b
    assert sorted(r["instance_id"] for r in a) == list(range(500)) and [r["position"] for r in a] == list(range(500))
    assert ordering.seeded_order(ids, 6).orderBy("position").collect() != a
    assert ordering.seeded_order(ids, 5, epoch=1).orderBy("position").collect() == ordering.seeded_order(ids, 6).orderBy("position").collect()


def test_stripes_partition_the_order(spark):
    order = spark.range(103).select(F.col("id").alias("position"), F.col("id").alias("instance_id"))
    start = 5
    striped = ordering.rank_stripe(ordering.slice_order(order, 4, None, start), 4, start)
    workers = ordering.worker_stripe(striped, 4, start, batch=3, workers=2, total=103).collect()
    assert sorted(r["instance_id"] for r in workers) == list(range(5, 103))
    for rank in range(4):
        mine = [r for r in workers if r["rank"] == rank]
        locals_ = sorted(mine, key=lambda r: r["position"])
        n = len(locals_)
        whole = n // 3 * 3
        ids = [r["instance_id"] for r in locals_]
        for w in range(2):
            batches = [ids[i : i + 3] for i in range(0, whole, 3)][w::2]
            want = [x for b in batches for x in b] + ids[whole + w :: 2]
            got = [r["instance_id"] for r in sorted((r for r in mine if r["worker"] == w), key=lambda r: r["worker_seq"])]
            assert got == want


def test_chunks_and_remainders_make_up_the_input(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"s{i % 5}", i * 997, [rng.randrange(100) for _ in range(rng.randrange(40))]) for i in range(300)]
    docs = spark.createDataFrame(rows, "source string, doc_id bigint, input_ids array<int>").withColumn("n_tokens", F.size("input_ids"))
    chunks = packing.pack_chunks(docs, 16).collect()
    manifest = {r["path"]: r for r in packing.chunk_manifest(docs, 16).collect()}
    for source in {r[0] for r in rows}:
        flat = [x for s, _, ids in sorted(rows, key=lambda r: r[1]) if s == source for x in ids]
        mine = sorted((r["chunk"], r["input_ids"]) for r in chunks if r["shard_id"] == source)
        assert [x for _, ids in mine for x in ids] == flat[: len(flat) // 16 * 16]
        assert manifest[source]["n_chunks"] == len(mine)
    spans = sorted((r["start"], r["end"]) for r in manifest.values())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("n", [1, 9, 10, 25, 104])
def test_folds_are_disjoint_and_complete(spark, n):
    got = readers.with_folds(spark.range(n), "id").collect()
    assert sorted(r["id"] for r in got) == list(range(n))
    for k in range(10):
        lo, hi = round(n * 10 * k / 100), round(n * 10 * (k + 1) / 100)
        assert sorted(r["id"] for r in got if r["fold"] == k) == list(range(lo, hi))
    for k in (0, 4, 9):
        one = readers.percent_fold(spark.range(n), "id", k).collect()
        assert sorted(r["id"] for r in one) == sorted(r["id"] for r in got if r["fold"] == k)


def naive_runs(x, max_period=13):
    out = set()
    for p in range(1, min(max_period, len(x) // 3) + 1):
        i = p
        while i < len(x):
            if x[i] != x[i - p]:
                i += 1
                continue
            j = i
            while j < len(x) and x[j] == x[j - p]:
                j += 1
            if j - i >= 2 * p:
                out.add((i - p, j, p, (j - i + p) // p))
            i = j
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=12))
def test_periods_against_plain_search(spark, lists):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<int>").coalesce(1)
    got = {r["i"]: {tuple(t) for t in r["r"]} for r in df.select("i", periodic_sequences(F.col("ids")).alias("r")).collect()}
    assert got == {i: naive_runs(x) for i, x in enumerate(lists)}


def test_mixture_amounts(spark):
    parts = {"a": spark.range(100), "b": spark.range(1000, 1100), "c": spark.range(2000, 2010)}
    mixed = mixture.mix_datasets(parts, mixture.parse_mixer_list(["a", 1.0, "b", 7, "c", 50]), "id", 3).collect()
    ids = sorted(r["id"] for r in mixed)
    assert len([i for i in ids if i < 1000]) == 100 and len([i for i in ids if 1000 <= i < 2000]) == 7 and len([i for i in ids if i >= 2000]) == 10


def test_shards_start_where_documents_start(spark):
    docs = spark.createDataFrame([("s", i, size) for i, size in enumerate((60, 60, 10, 200, 5))], "source string, doc_id bigint, n bigint")
    got = writers.shard_by_size(docs, "doc_id", F.col("n"), 100).orderBy("doc_id").collect()
    assert [r["shard"] for r in got] == [0, 0, 1, 1, 3]


def test_collation_keeps_only_what_is_there(spark):
    rows = spark.createDataFrame([(0, 0, [1, 2], {"path": "x"}), (0, 1, [3], {"path": "y"})], "b int, o int, input_ids array<int>, metadata map<string,string>")
    row = ordering.collate_batches(rows, ["b"], "o", 9, "left", index=None).first()
    assert row["input_ids"] == [[1, 2], [9, 3]] and row["metadata"] == [{"path": "x"}, {"path": "y"}]
    assert "label_mask" not in row.asDict()
