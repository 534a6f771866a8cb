"""Line, chunk and shingle deduplication against brute force on small tables."""

from __future__ import annotations

import random
import re
import sys
import os

import numpy as np
from pyspark.sql import functions as F
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from cases import CLASH, PROSE, ROWS, documents, empty  # noqa: E402

from millrace.llm import chunk_dedup, count_rtree, line_dedup, ngram_join, words  # noqa: E402
from millrace.llm.components import star_forest  # noqa: E402


def texts(n, seed, size=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, size))] for _ in range(n // 3)]
    out = []
    for i in range(n):
        ws = list(base[i % len(base)])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        out.append(" ".join(ws))
    return out


def groups(rows, size, percent):
    """(shingles, smallest linked id) of each id, by comparing every pair."""
    sets = {}
    for doc, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_word_hashes_follow_the_contract():
    raw = ["AbC dEf", "abc\x0bdef", "a\xa0b", "", "  x", "É É é"]
    found = [w.hashes[a:b] for _, r, o in words.slices(pa.array(raw)) for w in [words.Words.of(r, o)] for a, b in zip(w.bounds[:-1], w.bounds[1:])]
    assert list(found[0]) == list(found[1])
    assert [len(f) for f in found] == [2, 2, 1, 0, 1, 3]
    assert found[5][0] == found[5][1] != found[5][2]  # only A-Z is lower-cased


def test_parts_never_miss_a_pair():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for n in (1, 2, 5, 9, 20, 31, 32, 33, 40, 41, 90, 300, 1500):
            for _ in range(30):
                a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
                b = list(a)
                while b and rng.random() < 0.9:
                    c = b[:-1] if rng.random() < 0.6 else [*b, np.uint64(rng.integers(0, 1 << 63)) * np.uint64(2)]
                    rng.shuffle(c)
                    shared = len(set(a.tolist()) & set(int(x) for x in c))
                    if not c or 100 * shared < percent * (n + len(c) - shared):
                        break
                    b = c
                left, right = np.sort(a), np.sort(np.array(b, np.uint64))
                assert set(ngram_join.part_keys(left, percent)) & set(ngram_join.part_keys(right, percent)), (n, len(b))


def test_tree_finds_what_comparing_finds():
    rng = np.random.default_rng(1)
    base = [np.sort(rng.integers(0, 1 << 63, rng.integers(1, 200), dtype=np.uint64)) for _ in range(30)]
    sets = [np.unique(np.concatenate((b[: len(b) - rng.integers(0, 4)], rng.integers(0, 1 << 63, rng.integers(0, 4), dtype=np.uint64)))) for b in base * 6]
    sets = [s for s in sets if len(s)]
    near = {(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))}
    bounded = {(max(i, j), min(i, j)) for a, b in count_rtree.CountTree(count_rtree.count_vectors(sets)).pairs(9, 10) for i, j in zip(a, b)}
    assert near <= bounded
    forest = count_rtree.linked(sets, 90, 100)
    assert {(max(p), min(p)) for p in forest} <= near


def test_groups_equal_brute_force(spark):
    rows = [(i * 3, t) for i, t in enumerate([*texts(120, 5), *texts(60, 6, 12), "", "a", "A", "a b", None])]
    for size, percent in ((3, 90), (5, 80)):
        got = ngram_join.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), size, percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups(rows, size, percent)


def test_similar_sizes_are_in_the_same_band_or_the_next(spark):
    for percent in (50, 80, 90, 100):
        sizes = spark.range(1, 6000).select(F.col("id"), F.floor(F.col("id") * 100 / percent).alias("most"))
        bands = sizes.select(ngram_join.band_of(F.col("id"), percent).alias("a"), ngram_join.band_of(F.col("most"), percent).alias("b"))
        assert bands.where("b not in (a, a + 1)").isEmpty()


def test_large_blocks_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 8)
    rows = list(enumerate(texts(90, 8, 60)))
    got = ngram_join.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups(rows, 3, 90)


def test_common_passages_alone_make_no_block(spark, monkeypatch):
    rng = np.random.default_rng(8)
    common = [" ".join(f"c{k}_{i}" for i in range(7)) for k in range(6)]
    rows = []
    for i in range(300):
        own = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 12)) for _ in common]
        rows.append((i, " ".join(w for pair in zip(own, rng.permutation(common)) for w in pair)))
    rows += [(300 + i, t + " end") for i, t in rows[:20]]
    blocks, links = [], ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda *a: blocks.append(a[2].groupBy("block").count().agg(F.max("count")).first()[0]) or links(*a))
    got = ngram_join.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % 300 if i >= 300 else i for i, _ in rows}
    assert blocks == [2]


def test_wide_parts_and_large_groups_lose_no_link(spark, monkeypatch):
    rows = [(i * 3, t) for i, t in enumerate(texts(120, 5, 12))]
    wanted = groups(rows, 3, 90)
    for wide, few in ((3, 32), (8192, 2)):
        monkeypatch.setattr(ngram_join, "WIDE", wide)
        monkeypatch.setattr(ngram_join, "FEW", few)
        table = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(table, 3, 90).collect()} == wanted
    keys = np.repeat(np.arange(5), [1, 3, 12, 2, 3])
    names = np.concatenate(([7], [1, 2, 2], np.arange(12), [1, 2], [4, 4, 4]))
    batches = [pa.record_batch([pa.array(keys[a : a + 4]), pa.array(names[a : a + 4])], names=["part", "class"]) for a in range(0, 21, 4)]
    monkeypatch.setattr(ngram_join, "WIDE", 3)
    got = {(r["group"] is None, r["class"], r["first"]) for b in ngram_join._runs(iter(batches)) for r in b.to_pylist()}
    assert got == {(False, 1, None), (False, 2, None)} | {(True, n, 0) for n in range(1, 12)}


def test_counts_never_exclude_a_similar_set():
    rng = np.random.default_rng(4)
    whole = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (1, 5, 60, 1000, 1030, 2100, 5000)]
    sets = [s[rng.random(len(s)) < share] for s in whole for share in (1, 0.97, 0.93, 0.88, 0.83)]
    points = [count_rtree.fine_counts(s) for s in sets]
    left, right = np.triu_indices(len(sets), 1)
    similar = np.array([5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])) for i, j in zip(left, right)])
    similar &= [len(sets[i]) > 0 for i in left]
    good = count_rtree.may_link(points, left, right, 80, 100)
    assert similar.sum() > 40 and good[similar].all() and not good.all()
    forest = count_rtree.allowed_forest(points, 80, 100)
    names = list(range(len(sets)))
    for i, j in forest:
        names = [names[i] if n == names[j] else n for n in names]
    assert all(names[i] == names[j] for i, j in zip(left[similar], right[similar]))


def test_groups_of_odd_rows(spark):
    got = ngram_join.near_groups(documents(spark, clash=True), 3, 90).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[9]["component_id"] == 1
    assert (by[3]["n_shingles"], by[3]["component_id"]) == (0, 3) and by[6]["n_shingles"] == 1
    kept = ngram_join.keep_first(documents(spark, clash=True))
    assert kept.columns == documents(spark, clash=True).columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 8, 10]
    assert ngram_join.near_groups(empty(spark)).count() == 0 and ngram_join.keep_first(empty(spark)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(7, 7), (41, 100)]
    got = dict(map(tuple, star_forest(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 41, **{j: 41 for j in range(101, 140)}}
    assert star_forest(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def site_rule(rows, sites=10):
    """Texts without the lines that stand on so many sites and in so many different texts."""
    where = {}
    for _, text, _, site, _ in rows:
        for line in set((text or "").split("\n")):
            line = line.strip(" \t\r\x0b\x0c")
            found = where.setdefault(line, (set(), set()))
            if site is not None:
                found[0].add(site)
            found[1].add(text)
    common = {line for line, (on, texts) in where.items() if line and min(len(on), len(texts)) >= sites}
    keep = lambda text: "\n".join(x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c") not in common)
    return {doc: None if text is None else keep(text) for doc, text, *_ in rows}


def test_lines_by_sites(spark):
    rows = []
    for i in range(40):
        # a frame of two lines above and below, which always stand between the same neighbours
        lines = ["HEAD one", "head two", f"own line {i} a", "COMMON  ", f"own line {i} b", "nine" if i % 12 < 9 else f"x{i}", "foot one", "foot two"]
        rows.append((i, "\n".join(lines), "en", f"s{i % 12}", 0))
    copied = "first of a copied text\nsecond of it\nthird of it"
    rows += [(100 + i, copied, "en", f"s{i}", 0) for i in range(20)]
    # one page copied a thousand times on one site does not keep its frame on the others
    rows += [(1000 + i, rows[0][1], "en", "s0", 0) for i in range(300)] + [(2000, "head two\nalone", "en", None, 0)]
    got = {r["doc_id"]: r for r in line_dedup.remove_boilerplate(documents(spark, rows)).collect()}
    assert {doc: r["text"] for doc, r in got.items()} == site_rule(rows)
    assert all((got[i]["n_lines"], got[i]["n_removed"]) == (8, 5) for i in range(40))
    assert got[100]["text"] == copied and got[2000]["text"] == "alone"


def test_near_thresholds_are_counted_exactly(spark):
    for sites in (9, 10, 11):
        for texts in (9, 10, 44):
            rows = [(i, f"a{i % texts}\nshared\nb{i % texts}", "en", f"s{i % sites}", 0) for i in range(44)]
            got = line_dedup.remove_boilerplate(documents(spark, rows)).where("n_removed > 0").count()
            assert got == (44 if sites >= 10 and texts >= 10 else 0)


def test_the_query_removes_lines_by_sites_alone(spark, tmp_path):
    from millrace.llm.queries import op1_line_dedup

    # one text on ten sites, one on nine, and four texts with a line of their own copied to twelve
    rows = [(i, "on ten\nevery copy", "en", f"s{i}", 0) for i in range(10)] + [(20 + i, "on nine", "en", f"s{i}", 0) for i in range(9)]
    rows += [(40 + i, f"own {i % 4}\nshared\nmore {i % 4}\nshared\nend {i % 4}", "en", f"s{i}", 0) for i in range(12)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    assert all(got[i] == ("", 2) for i in range(10)) and all(got[20 + i] == ("on nine", 0) for i in range(9))
    assert all(got[40 + i] == (f"own {i % 4}\nmore {i % 4}\nend {i % 4}", 2) for i in range(12))


def test_lines_of_odd_rows(spark):
    df = documents(spark, clash=True)
    got = line_dedup.remove_boilerplate(df, min_sites=2)
    assert set(df.columns) <= set(got.columns)
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == sorted((r[0] or 0) for r in ROWS)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[3]["text"] is None and by[3]["n_lines"] == 0 and by[4]["text"] == "" and by[5]["text"] == "   \n \n"
    assert line_dedup.remove_boilerplate(empty(spark)).count() == 0


def test_chunks_resist_insertions():
    passage = PROSE.encode()
    alone = np.frombuffer(passage, np.uint8)
    shifted = np.frombuffer(b"something before " + passage, np.uint8)
    ends = chunk_dedup.chunk_ends(alone, np.array([0, len(alone)]))
    moved = chunk_dedup.chunk_ends(shifted, np.array([0, len(shifted)])) - 17
    assert len(set(ends) & set(moved)) >= len(ends) - 2 and np.diff(ends).max() <= chunk_dedup.LONGEST + 3
    two = np.frombuffer(passage + passage, np.uint8)
    split = chunk_dedup.chunk_ends(two, np.array([0, len(alone), len(two)]))
    assert list(split) == [*ends, *(ends + len(alone))]


def test_repeated_passages_go_and_the_first_stays(spark):
    rng = random.Random(2)
    own = lambda i: " ".join(f"own{i}x{rng.randrange(10**6)}" for _ in range(60))
    passage = " ".join(f"passage{rng.randrange(10**6)}" for _ in range(60))
    rows = [(i, f"{own(i)} {passage} {own(i)}" if i % 3 else own(i), "en", "s", 0) for i in range(1, 13)]
    got = {r["doc_id"]: r for r in chunk_dedup.remove_repeats(documents(spark, rows)).collect()}
    for i, text, *_ in rows:
        spans = got[i]["spans"]
        if i % 3 == 0 or i == 1:
            assert got[i]["text"] == text and not spans
        else:
            assert got[i]["first_ids"] == [1] and sum(s["length"] for s in spans) > 0.8 * len(passage)
            back, at = [], 0
            for s in spans:
                back.append(text[at : s["start"]])
                at = s["start"] + s["length"]
            assert "".join([*back, text[at:]]) == got[i]["text"]


def test_short_passages_go_whole(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 8)))
    own = lambda: " ".join(word() for _ in range(60))
    rows, passages = [], {}
    for k in range(40):
        passages[k] = " ".join(word() for _ in range(51))
        rows += [(2 * k, f"{own()} {passages[k]} {own()}", "en", "s", 0), (2 * k + 1, f"{own()} {passages[k]} {own()}", "en", "s", 0)]
    got = {r["doc_id"]: r for r in chunk_dedup.remove_repeats(documents(spark, rows)).collect()}
    for k, passage in passages.items():
        assert got[2 * k]["text"] == rows[2 * k][1]
        left = got[2 * k + 1]
        (span,) = left["spans"]
        assert passage in rows[2 * k + 1][1][span["start"] : span["start"] + span["length"]] and left["first_ids"] == [2 * k]
        assert span["length"] <= len(passage) + 12


def test_repeats_equal_brute_force(spark):
    """Nearly every byte of runs that an earlier text has goes, and nothing that no earlier text has."""
    rng = np.random.default_rng(31)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), rng.integers(2, 10))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    passages = [say(51) for _ in range(25)]
    texts = []
    for i in range(120):
        parts = [say(int(rng.integers(5, 60)))]
        for k in rng.choice(25, int(rng.integers(0, 3)), replace=False):
            parts += [passages[k], say(int(rng.integers(5, 60)))]
        texts.append(" ".join(parts))
    got = {r["doc_id"]: r for r in chunk_dedup.remove_repeats(documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    shortest, piece = min(len(p.encode()) for p in passages), 16
    long_runs, pieces, repeated, missed = set(), set(), 0, 0
    for i, text in enumerate(texts):
        raw = text.encode()
        removed = np.zeros(len(raw), bool)
        for s in got[i]["spans"]:
            a = len(text[: s["start"]].encode())
            removed[a : a + len(text[s["start"] : s["start"] + s["length"]].encode())] = True
        runs = {raw[p : p + shortest]: p for p in range(len(raw) - shortest + 1)}
        marked, known = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        for run, p in runs.items():
            if run in long_runs:
                marked[p : p + shortest] = True
        own = [raw[p : p + piece] for p in range(len(raw) - piece + 1)]
        for p, part in enumerate(own):
            if part in pieces:
                known[p : p + piece] = True
        assert not (removed & ~known).any()
        repeated += int(marked.sum())
        missed += int((marked & ~removed).sum())
        long_runs.update(runs)
        pieces.update(own)
    assert repeated > 15_000 and missed <= 0.01 * repeated


def test_chunks_of_odd_rows(spark):
    got = chunk_dedup.remove_repeats(documents(spark, clash=True))
    assert set(CLASH) <= set(got.columns)
    rows = got.collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == sorted((r[0] or 0) for r in ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["text"] is None and by[4]["text"] == "" and by[1]["text"] == PROSE and len(by[2]["text"]) < len(PROSE)
    assert by[8]["text"] == ROWS[7][1] and len(by[10]["text"]) < 2000
    assert chunk_dedup.remove_repeats(empty(spark)).count() == 0
