"""SimHash groups, collocations and word runs against brute force on small tables."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from cases import CLASH, KIND, LONG, PROSE, ROWS, documents, empty  # noqa: E402

from millrace.llm import phrases, queries, recompression, simhash_ring, word_runs  # noqa: E402
from millrace.llm.quotient_filter import Filter, Packing  # noqa: E402


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- SimHash -----------------------------------------------------------------------------------


def simhash(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def reached(prints, radius):
    """Smallest index of the component of each fingerprint, all pairs compared."""
    root = list(range(len(prints)))
    changed = True
    near = [[j for j in range(len(prints)) if bin(prints[i] ^ prints[j]).count("1") <= radius] for i in range(len(prints))]
    while changed:
        changed = False
        for i, others in enumerate(near):
            least = min(root[j] for j in others)
            if least < root[i]:
                root[i], changed = least, True
    return root


def test_fingerprints_equal_the_definition():
    for text in ["", None, "One", "A b", "a B c d", "x " * 90, "É x\x0by z q\x85r s", PROSE, "你好 you 😀 me " * 5]:
        assert simhash_ring.simhash((text or "").encode(), 3) == simhash(text), text


@pytest.mark.parametrize("radius", range(8))
def test_every_close_pair_has_a_chain_in_budget(radius):
    rng = np.random.default_rng(radius)
    for _ in range(500):
        differing = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, radius + 1), replace=False))
        turns = np.array([((differing >> 8 * s) | (differing << (64 - 8 * s))) % (1 << 64) for s in range(8)], np.uint64)
        assert len(simhash_ring.within(turns, radius))
    far = sum(1 << int(b) for b in rng.choice(64, radius + 1, replace=False))
    assert not len(simhash_ring.within(np.array([far], np.uint64), radius))


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash_ring, "TILE", 16)  # buckets of near fingerprints are cut into sides
    rng = np.random.default_rng(7)
    centres = [int(x) for x in rng.integers(0, 1 << 62, 6)] + [0, (1 << 64) - 1]
    prints = set(centres)
    for _ in range(400):
        bits = rng.choice(64, rng.integers(0, 2 * radius + 2), replace=False)
        prints.add(centres[rng.integers(len(centres))] ^ sum(1 << int(b) for b in bits))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    place = {p: i for i, p in enumerate(signed)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for row in simhash_ring.links(table, radius).collect():
        i, j = place[row.a], place[row.b]
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == reached(prints, radius)


def test_tiles_of_stars_find_all(spark):
    rng = np.random.default_rng(2)
    chains = np.unique(np.array([sum(1 << int(b) for b in rng.choice(20, 4)) for _ in range(300)], np.uint64))
    found = sorted(sorted(s.tolist()) for s in simhash_ring.stars(chains, 3))
    # a bucket only promises pairs whose chain from the lowest segment on keeps its budget
    near = [[j for j in range(len(chains)) if len(simhash_ring.within(chains[i : i + 1] ^ chains[j : j + 1], 3))] for i in range(len(chains))]
    seen, want = set(), []
    for i in range(len(chains)):
        if i not in seen:
            group, waiting = {i}, [i]
            while waiting:
                for j in near[waiting.pop()]:
                    if j not in group:
                        group.add(j)
                        waiting.append(j)
            seen |= group
            if len(group) > 1:
                want.append(sorted(group))
    assert found == sorted(want)


def near_texts(n, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 200))] for _ in range(n // 8)]
    out = []
    for i in range(n):
        words = list(base[i % len(base)])
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
        out.append(" ".join(words))
    return out


def test_simhash_groups_equal_all_pairs(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([None, "", " \n", *near_texts(240, 3), LONG])]
    prints = [simhash(r[1]) if r[1] is not LONG else simhash_ring.simhash(LONG.encode(), 3) for r in rows]
    got = {r.doc_id: (r.fingerprint % (1 << 64), r.component_id) for r in simhash_ring.near_groups(documents(spark, rows)).collect()}
    want = {i: (p, root) for i, (p, root) in enumerate(zip(prints, reached(prints, 3)))}
    assert got == want
    assert got[0] == got[1] == got[2] == (0, 0)


def test_simhash_odd_rows(spark):
    found = simhash_ring.near_groups(documents(spark, clash=True)).collect()
    assert len(found) == len(ROWS)
    by_id = {}
    for row in found:
        by_id.setdefault(row.doc_id, []).append((row.fingerprint, row.component_id))
    assert by_id[3] == by_id[4] == by_id[5] == [(0, 3)]
    assert by_id[8] == [by_id[8][0]] * 2 and by_id[8][0][1] == 8
    assert by_id[1][0] == by_id[2][0] and by_id[2][0][1] == 1
    assert by_id[None][0][1] is None  # its group has no other id
    assert simhash_ring.near_groups(empty(spark)).collect() == []


# --- Collocations -------------------------------------------------------------------------------


def collocations(rows, least=10, top=2000, percent=50):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, own in counts.items():
        chosen = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        scored = []
        for g, a in chosen.items():
            if any(100 * b >= percent * a for h, b in chosen.items() if len(h) > len(g) and g in (h[:2], h[1:])):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["the", "New", "york", "city", "of", "Über", "naïve", " ", "a\x00b", "x\x1cy", "你好", "end"]
    rows = []
    for _ in range(120):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(["new york city", "of the", *words]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "?! "])
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("head", [1 << 16, 6, 1])
def test_collocations_equal_counting_all(spark, monkeypatch, head):
    monkeypatch.setattr(phrases, "FILTER_NGRAMS", 500)
    monkeypatch.setattr(phrases, "COUNTER_WORDS", 20)
    rows = corpus()
    table = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string").repartition(3)
    got = phrases.collocations(table, least=4, top=25, head_words=head)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == collocations(rows, 4, 25)


def test_collocations_of_odd_rows(spark):
    rows = [(r[1], r[2]) for r in ROWS]
    assert sorted(map(tuple, phrases.collocations(documents(spark, clash=True)).collect())) == collocations(rows)
    assert phrases.collocations(empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " .\n", "en")], "doc_id bigint, text string, lang string")
    assert phrases.collocations(blank).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_019, 3_000_000_021, 3_000_000_037
    row = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    score = row.select(phrases._score(row["a"], row["l"], row["r"]).alias("s")).first()["s"]
    assert score == 1_000_000 * a * a // (left * right)


@pytest.mark.parametrize("width", [1, 2, 7, 17, 21, 22, 31, 42])
def test_filters_lose_nothing(width):
    rng = np.random.default_rng(width)
    ids = [rng.integers(0, min(1 << width, 40), 3000) | (rng.integers(0, 2, 3000) << (width - 1)) for _ in range(3)]
    times = rng.integers(1, 400, 3000)
    for shard_bits in (4, 9):
        packing = Packing(width, shard_bits)
        parts = [Filter.of(packing, *packing.pack(*[x[s] for x in ids]), times[s]) for s in (slice(0, 1000), slice(1000, 3000))]
        sent = [Filter.from_bytes(shard.to_bytes()) for part in parts for _, shard in part.shards()]
        merged = Filter.merge(packing, sent)
        want = Counter()
        for i, j, k, c in zip(*[x.tolist() for x in ids], times.tolist()):
            want[i, j, k] += c
        assert {tuple(r[:3]): r[3] for r in zip(*[x.tolist() for x in merged.ngrams()])} == want
        assert sum(c for *_, c in zip(*[x.tolist() for x in merged.ngrams(500)])) == sum(c for c in want.values() if c >= 500)


def test_a_counter_takes_about_a_byte():
    rng = np.random.default_rng(0)
    packing = Packing(17, 4)
    full = Filter.of(packing, *packing.pack(*[rng.integers(1, 1 << 17, 1 << 18) for _ in range(3)]))
    assert sum(len(shard.to_bytes()) for _, shard in full.shards()) < 8 * len(full.left)


# --- Word runs ----------------------------------------------------------------------------------


def word_run_list(words):
    """Every run, by comparing each word with the one a period further on."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            smaller = any(all(words[t] == words[t + d] for t in range(start, end - d)) for d in range(1, q))
            if end - start >= max(6, 4 * q) and not smaller:
                out.add((start, end - start, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    letters = rng.choice([1, 2, 3, 20])
    words = [b"%d" % rng.randrange(letters) for _ in range(rng.choice([0, 1, 5, 30, 120]))]
    for _ in range(rng.choice([0, 1, 2])):
        block = [b"%d" % rng.randrange(letters + 1) for _ in range(rng.choice([1, 2, 3, 7, 15]))]
        words += block * rng.choice([3, 4, 5, 9]) + block[: rng.randrange(len(block))]
        words += [b"%d" % rng.randrange(letters) for _ in range(rng.choice([0, 1, 5]))]
    return words


def test_runs_equal_comparing_all_words():
    rng = random.Random(11)
    for _ in range(60):
        texts = [periodic_words(rng) for _ in range(12)]
        assert word_runs.runs_of(texts) == [word_run_list(words) for words in texts]
    fibonacci = [b"a", b"ab"]
    while len(fibonacci[-1]) < 2000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for word in (fibonacci[-1][:1500], b"a" * 700, b"ab" * 300 + b"a", b"aab" * 4 + b"aab" * 50 + b"b" * 9):
        words = [bytes([c]) for c in word]
        assert word_runs.runs_of([words, [], words[:3]])[0] == word_run_list(words)


def test_extensions_equal_comparing_words():
    rng = np.random.default_rng(5)
    part = rng.integers(0, 2, 2000)
    sequence = np.concatenate(([10], part, [5] * 300, part, [5] * 299, [11]))
    grammar = recompression.Grammar(sequence)
    assert len(grammar.levels) > 10
    i = rng.integers(1, 2200, 400)
    j = np.minimum(i + rng.choice([1, 2, 2299, 2300, 2301], 400), len(sequence) - 2)
    for x, y, ahead, behind in zip(i, j, grammar.common_ahead(i, j), grammar.common_behind(i, j)):
        n = m = 0
        while sequence[x + n] == sequence[y + n]:
            n += 1
        while sequence[x - 1 - m] == sequence[y - 1 - m]:
            m += 1
        assert (ahead, behind) == (n, m)


def test_runs_of_odd_rows(spark):
    found = word_runs.with_runs(documents(spark, clash=True).withColumnRenamed("k", "runs")).collect()
    assert len(found) == len(ROWS)
    for row in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        if row.doc_id != 7:
            assert [(r["start"], r["length"], r["period"]) for r in row["runs_"]] == word_run_list(words)
        assert row.runs == "x"
    by_id = {r.doc_id: r for r in found}
    assert [tuple(r) for r in by_id[10]["runs_"]] == [(0, 500, 1)] and by_id[10].collapsed == "aaa"
    assert by_id[3].collapsed == by_id[4].collapsed == by_id[5].collapsed == "" and by_id[3].text is None
    assert by_id[6].collapsed == "one" and set(CLASH) - {"k"} < set(found[0].asDict())
    assert word_runs.with_runs(empty(spark)).collect() == []


def digests(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = word_run_list(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    return (
        doc_id, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_the_query_of_runs_equals_the_definition(spark, tmp_path):
    rng = random.Random(4)
    rows = [(None, "x y " * 9), (5, None)]
    for i in range(400):
        words = [w.decode() for w in periodic_words(rng)]
        rows.append((i, rng.choice([" ", "\n\t", "\x0b "]).join(words) if i % 50 else ""))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(400)) > 20
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((digests(*r) for r in rows), key=str)


def test_the_query_of_simhash_equals_the_definition(spark, tmp_path):
    rows = list(enumerate([None, "", *near_texts(120, 9)], 10))
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    prints = [simhash(t) for _, t in rows]
    want = {(i, f"{p:016x}", root + 10) for (i, _), p, root in zip(rows, prints, reached(prints, 3))}
    assert set(map(tuple, queries.op11_simhash_dedup(spark, str(tmp_path)).collect())) == want
