"""Classifier, fingerprints, decontamination, extraction, archives, tokens, language model, pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from cases import CLASH, LONG, PROSE, ROWS, documents, empty  # noqa: E402

from millrace.llm import bpe, decontaminate, gru_lm, html_text, lm_scoring, mil_classifier, syncmers, warc  # noqa: E402

SF = "/root/testdata/sf0.001"


def ids_of(df):
    return sorted((r["doc_id"] or 0) for r in df.select("doc_id").collect())


ALL_IDS = sorted((r[0] or 0) for r in ROWS)


# --- quality ---------------------------------------------------------------------------


def test_gradients_of_attention():
    rng = np.random.default_rng(0)
    x = rng.random((9, mil_classifier.FEATURES)).astype(np.float32)
    bounds, y = np.array([0, 2, 3, 9]), np.array([1, 0, 1], np.float32)
    model = mil_classifier.train(x, bounds, y, epochs=1)
    model.weights = {k: np.asarray(v, np.float64) for k, v in model.weights.items()}
    loss = lambda: -np.mean(np.where(y > 0, np.log(model.score(x, bounds)), np.log(1 - model.score(x, bounds))))
    for name, g in model.gradients(x, bounds, y).items():
        w = model.weights[name]
        at = (0,) * np.ndim(w)
        for sign in (1,):
            step = np.zeros_like(w)
            step[at] = 1e-5
            model.weights[name] = w + step
            up = loss()
            model.weights[name] = w - step
            down = loss()
            model.weights[name] = w
            assert abs((up - down) / 2e-5 - np.asarray(g)[at]) < 1e-4 * sign


def test_quality_on_documents_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = mil_classifier.fit(docs, labels.where(~held))
    got = mil_classifier.score(docs, model).where(held).join(labels, "doc_id").select("score", "quality").collect()
    assert len(got) > 50
    assert sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in got) >= 0.97 * len(got)


def test_training_sees_every_passage():
    batch = pa.record_batch([pa.array([1.0, 0.0]), pa.array(["word " * 20_000, "word"])], names=["y", "text"])
    (rows,) = mil_classifier._sampled(iter([batch]))
    assert [len(x) // 2 // mil_classifier.FEATURES for x in rows.column("x").to_pylist()] == [-(-20_000 // mil_classifier.PASSAGE), 1]


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (10, 0), (None, 1), (4, None), (1, 1)], "doc_id bigint, quality int")
    model = mil_classifier.fit(documents(spark, clash=True), labels)
    got = mil_classifier.score(documents(spark, clash=True), model)
    assert ids_of(got) == ALL_IDS and all(0 <= r["score"] <= 1 for r in got.collect())
    assert mil_classifier.fit(documents(spark), labels.limit(0)) is None
    assert {r["score"] for r in mil_classifier.score(documents(spark), None).collect()} == {0.5}
    assert mil_classifier.score(empty(spark), model).count() == 0


# --- decontamination -------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def contaminated(docs, items, percent=80):
    """Every window of every document against every item."""
    out = {}
    for doc, text in docs:
        w = words_of(text)
        for item, question in items:
            q = words_of(question)
            g = min(5, len(q))
            if not q or len(w) < g:
                continue
            grams = lambda x: Counter(tuple(x[i : i + g]) for i in range(len(x) - g + 1))  # noqa: B023, E731
            own, best = grams(q), None
            for s in range(max(len(w) - len(q), 0) + 1):  # a shorter document is one window
                there = grams(w[s : s + len(q)])
                small, large = sum((own & there).values()), sum((own | there).values())
                if 100 * small >= percent * large and (best is None or small / large > best[0]):
                    best = (small / large, s)
            if best:
                out[doc, item] = best
    return out


def test_windows_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(draw(rng.choice([2, 4, 5, 9, 30, 31, 50])))) for i in range(20)] + [(50, ""), (51, None), (52, "a a a a a a a a a a a a")]
    docs = []
    for i in range(60):
        q = items[rng.randrange(20)][1].split()
        if rng.random() < 0.6 and len(q) > 8:
            q[rng.randrange(len(q))] = "changed"
        if rng.random() < 0.2:
            q.insert(rng.randrange(len(q)), "added")
        docs.append((i, ", ".join(draw(rng.randint(0, 30))) + " " + " ".join(q).upper() + ". " + " ".join(draw(20))))
    docs += [(90, None), (91, ""), (92, "a " * 40)]
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    ).collect()
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in got} == contaminated(docs, items)


def test_documents_shorter_than_an_item(spark):
    q = [f"q{i}" for i in range(37)]
    items = [(1, " ".join(q)), (2, "one two")]
    docs = [(1, " ".join(q[:35])), (2, " ".join(q[1:36])), (3, " ".join(q[:30])), (4, " ".join(q[:20])), (5, "one"), (6, " ".join(q))]
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    ).collect()
    want = {(1, 1): 31 / 33, (2, 1): 31 / 33, (6, 1): 1.0}
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got} == want and all(r["start_word"] == 0 for r in got)


def test_masks_reach_the_radius():
    rng = random.Random(1)
    assert decontaminate.radius_of(80) == 24 and decontaminate.radius_of(100) == 0
    for percent in (50, 80, 95):
        radius = decontaminate.radius_of(percent)
        masks = set(decontaminate.near_masks(radius))
        for _ in range(300):
            a = rng.getrandbits(63)
            b = a
            for bit in rng.sample(range(63), rng.randint(0, radius)):
                b ^= 1 << bit
            assert any((a >> 7 * k & 127) ^ (b >> 7 * k & 127) in masks for k in range(9))


def test_items_of_few_shingles_are_found(spark):
    # every bit in which two shingles differ turns when one of them comes once less
    pairs = [(f"x{i}", f"y{i}") for i in range(30)]
    items = [(i, " ".join([x, y] * 7 + [x])) for i, (x, y) in enumerate(pairs)]
    docs = [(i, " ".join([y, x] * 7 + [y])) for i, (x, y) in enumerate(pairs)]
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    ).collect()
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in got} == contaminated(docs, items)
    assert len(got) == 30


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_texts_of_few_words_equal_brute_force(spark, percent):
    rng = random.Random(percent)
    words = ["a", "b", "c", "d"]
    draw = lambda n, most: " ".join(rng.choice(words[:most]) for _ in range(n))
    items = [(i, draw(rng.randint(1, 30), rng.randint(1, 4))) for i in range(25)]
    docs = []
    for i in range(40):
        w = (draw(rng.randint(0, 25), rng.randint(1, 4)) + " " + items[rng.randrange(25)][1]).split()
        w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, " ".join(w[rng.randint(0, 4) :])))
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), percent
    ).collect()
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in got} == contaminated(docs, items, percent)


def test_simhash_is_a_majority_vote(spark):
    rng = random.Random(9)
    rows = [([rng.getrandbits(64) - 2**63 for _ in range(n)],) for n in (1, 2, 5, 60, 255, 300)]
    df = spark.createDataFrame(rows, "g array<bigint>")
    for most, width in ((255, 9), (300, 21)):
        for r in df.where(F.size("g") <= most).select("g", decontaminate.simhash(F.col("g"), most).alias("b")).collect():
            for j in range(width):
                for k in range(63 // width):
                    votes = sum(h >> (k * width + j) & 1 for h in r["g"])
                    assert r["b"] >> (k * width + width - 1 - j) & 1 == (votes > len(r["g"]) // 2)


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, PROSE), (2, None), (None, "x"), (3, "one")], "item_id bigint, text string")
    df = documents(spark, clash=True)
    kept = decontaminate.remove_contaminated(df, bench)
    assert kept.columns == df.columns and ids_of(kept) == sorted(set(ALL_IDS) - {1, 2, 9, 6} | {8} and [i for i in ALL_IDS if i not in (1, 2, 9, 6)])
    assert ids_of(decontaminate.remove_contaminated(df, bench.limit(0))) == ALL_IDS
    assert decontaminate.contamination(empty(spark), bench).count() == 0


# --- fingerprints ----------------------------------------------------------------------


def test_syncmers_by_definition():
    raw = np.frombuffer(PROSE.encode()[:400], np.uint8)
    at, _ = syncmers.closed_syncmers(raw)
    inner = syncmers.run_hashes(raw, syncmers.S)
    width = syncmers.K - syncmers.S + 1
    assert [p for p in range(len(raw) - syncmers.K + 1) if min(inner[p : p + width]) in (inner[p], inner[p + width - 1])] == list(at)
    moved, _ = syncmers.closed_syncmers(np.frombuffer(b"xyz " + raw.tobytes(), np.uint8))
    assert set(at + 4) <= set(moved)


def test_next_documents_and_likeness(spark):
    rows = [(5, PROSE, None, None, None), (2, "ab", None, None, None), (9, "", None, None, None), (30, PROSE + "!", None, None, None), (31, None, None, None, None), (7, LONG, None, None, None)]
    got = {r["doc_id"]: r for r in syncmers.with_next(documents(spark, rows)).collect()}
    order = sorted((d, t or "") for d, t, *_ in rows)
    for i, (doc, text) in enumerate(order):
        after, cut = order[(i + 1) % len(order)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert got[doc]["n_chars"] == len(text) and got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[9]["fingerprint"] == got[31]["fingerprint"] != got[5]["fingerprint"]
    assert got[5]["near_edited"] > 0.4 and got[7]["near_edited"] > 0.4 and got[5]["near_next"] < 0.1
    a, b = (syncmers.fingerprints(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in (PROSE, "moved: " + PROSE))
    assert syncmers.likeness(a, a) == 1 and syncmers.likeness(a, b) > 0.8


def test_fingerprints_of_odd_rows(spark):
    got = syncmers.with_next(documents(spark, clash=True))
    assert ids_of(got) == ALL_IDS
    by = {r["doc_id"]: r["fingerprint"] for r in got.collect()}
    assert by[1] == by[2] and by[3] == by[4]
    assert syncmers.with_next(empty(spark)).count() == 0
    assert set(CLASH) <= set(syncmers.fingerprint(documents(spark, clash=True)).columns)


# --- pages -----------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="ad">Buy a very long advert sentence that goes on and on.</div><article><h1>Head &amp; line</h1><p>First <b>para</b>graph,
  long enough.<p>Short.<br>x &lt; y<div class="comments"><p>Nice post, I like what you wrote about it all!</p></div></article>
<aside><p>Side text that is long enough to look like an article.</p></aside><script>var t="</p>";</script><footer>&copy; us</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line First paragraph, long enough. Short. x < y"
    assert html_text.main_text("<div><ul><li><a>a</a></li><li><a>b</a></li></ul></div><div><p>" + "Words of prose. " * 9 + "</p></div>") == ("Words of prose. " * 9).strip()
    for odd in (None, "", "   ", "<", "<p", "<p>", "</div></div>", "<!-- x", "<script>never closed", "&#0;&bad;<b><i>"):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("plain text") == "plain text"


def test_articles_of_given_pages(spark):
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("text", F.lit("clash"))
    for r in html_text.extract(pages).collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split()) and r["n_chars"] == len(r["text"])
    assert html_text.extract(pages.limit(0)).count() == 0


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (3, None, None), (4, "x\r\ny", ""), (5, "http://é/", "é" * 70_000), (None, "u", "<p>same</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("first", F.lit(1)).repartition(3)
    path = warc.write_archive(pages)
    got = {r["page_id"]: r for r in warc.page_index(spark, path).collect()}
    for page, _, html in rows:
        data = (html or "").encode()
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {p: (r["record_type"], r["refers_to"]) for p, r in got.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("response", None)}
    records = warc.read_archive(spark, path)
    assert {r["payload"] for r in records.where("record_type = 'revisit'").collect()} == {None}
    assert records.where("record_id = 'urn:page:5'").first()["payload"].decode() == "é" * 70_000
    assert records.where("target_uri is null").count() == 1 and records.where("not record_type = 'revisit' and refers_to is null").count() == 4
    smaller = warc.page_index(spark, warc.write_archive(pages, min_bytes=5))
    assert {r["page_id"] for r in smaller.where("record_type = 'revisit'").collect()} == {1}
    assert warc.page_index(spark, warc.write_archive(pages.limit(0))).count() == 0
    # archives of others, compressed and with records of other types
    other = tmp_path / "other"
    other.mkdir()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    row = {"record_type": "response", "record_id": "urn:page:7", "target_uri": "u", "refers_to": None, "payload": b"hi", "payload_length": 2, "payload_sha1": hashlib.sha1(b"hi").hexdigest()}
    (other / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(warc.record_bytes(row, "2020-01-01T00:00:00Z")))
    assert [r["payload"] for r in warc.read_archive(spark, str(other)).where("record_type = 'response'").collect()] == [b"hi"]
    assert [tuple(r) for r in warc.page_index(spark, str(other)).select("page_id", "payload_bytes").collect()] == [(7, 2)]


def test_unwanted_payloads_are_never_read(tmp_path):
    row = {"record_type": "response", "record_id": "a", "target_uri": "u", "refers_to": None, "payload": b"z" * 3_000_000, "payload_length": 3_000_000, "payload_sha1": "00"}
    (tmp_path / "x.warc").write_bytes(warc.record_bytes(row, "d") * 3)

    class Counting:
        def __init__(self, file):
            self.file, self.read_bytes = file, 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            data = self.file.read(n)
            self.read_bytes += len(data)
            return data

    with open(tmp_path / "x.warc", "rb") as file:
        source = Counting(file)
        assert len(list(warc.scan(source, 0, None))) == 3 and source.read_bytes < 500_000


# --- tokens ----------------------------------------------------------------------------


def tokenizer():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    model = tokenizers.Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return path, model


def test_encoding_equals_the_library(spark):
    path, model = tokenizer()
    vocabulary = bpe.Vocabulary.read(path)
    rng = random.Random(3)
    odd = ["", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "aaaaaaaaaaa aaa", " \n\n x  ", "'sup don't 's we're'll' I'D ''s it's\n'red x'v 'l", "a\xa0b   c\x1cd\t\te \n f", "你好 😀😀 ́é", "x" * 3000, LONG[:5000]]
    odd += ["".join(rng.choice("ab' s\n!1é\xa0你t") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    ids, bounds = bpe.encode_texts(vocabulary, odd)
    want = [e.ids for e in model.encode_batch(odd, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert bpe.decode_ids(vocabulary, ids, bounds) == odd == [model.decode(w, skip_special_tokens=False) for w in want]
    assert bpe.decode_ids(vocabulary, np.array([99999, -1, 0, 241]), np.array([0, 4])) == ["!" + model.decode([241])]


def test_tokens_of_odd_rows(spark):
    path, model = tokenizer()
    vocabulary = bpe.shared_vocabulary(spark, path)
    df = documents(spark, clash=True)
    got = bpe.decode(bpe.encode(df, vocabulary), vocabulary).collect()
    for r in got:
        assert r["input_ids"] == model.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    assert sorted((r["doc_id"] or 0) for r in got) == ALL_IDS
    assert bpe.encode(empty(spark), vocabulary).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,), ([],)], "input_ids array<int>"), vocabulary).distinct().collect()[0]["decoded"] == ""


# --- language model --------------------------------------------------------------------


def test_gradients_of_the_recurrent_model():
    layout = gru_lm.Layout(120, 4)
    rng = np.random.default_rng(1)
    weights = gru_lm.start_weights(layout, np.ones(layout.word_classes + 4), np.ones(120))
    weights = {k: v.astype(np.float64) for k, v in weights.items()}
    docs = [rng.integers(0, 124, n) for n in (5, 9, 3)]
    base = -gru_lm.score_documents(weights, layout, docs).sum() * math.log(10) / 17
    tokens = np.concatenate(docs)[:, None]
    fresh = np.zeros((17, 1), bool)
    fresh[[0, 5, 14]] = True
    caught = {}

    class Probe(gru_lm.Trainer):
        pass

    trainer = Probe({k: v.copy() for k, v in weights.items()}, layout, rate=0.0)
    trainer._window(np.zeros((1, gru_lm.STATE)), np.zeros(1, np.int64), tokens, fresh, np.ones((17, 1), bool), 1)
    norm = None
    for name in ("wx", "wh", "b", "wc", "uw", "embed", "bc", "bw"):
        g = trainer.first[name] / 0.1
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        moved = {k: v.copy() for k, v in weights.items()}
        moved[name][at] += 1e-5
        up = -gru_lm.score_documents(moved, layout, docs).sum() * math.log(10) / 17
        caught[name] = (up - base) / 1e-5 / g[at]
    norm = np.median(list(caught.values()))  # clipping scales all alike
    assert all(abs(v / norm - 1) < 0.02 for v in caught.values()), caught


def test_classes_of_words_cost_evenly():
    for counts in (np.ones(1), np.ones(500), np.arange(400, 0, -1) ** 3, np.array([10**9, *[1] * 300]), np.zeros(7), np.zeros(0)):
        cuts = gru_lm.class_cuts(counts)
        share = (counts + 0.5) / max((counts + 0.5).sum(), 1)
        assert cuts[0] == 0 and cuts[-1] == len(counts) and (np.diff(cuts) > 0).all()
        parts = [share[a:b].sum() * (b - a) for a, b in zip(cuts[:-1], cuts[1:])]
        assert all(p <= 1 + 1e-9 or b - a == 1 for p, a, b in zip(parts, cuts[:-1], cuts[1:]))
        # no class could take its next word too
        assert all(share[a : b + 1].sum() * (b + 1 - a) > 1 - 1e-9 for a, b in zip(cuts[:-2], cuts[1:-1]))
    layout = gru_lm.Layout(400, 3, np.arange(400, 0, -1) ** 3)
    assert list(layout.class_of(np.array([0, 399, 400, 402]))) == [0, *(layout.word_classes + np.array([-1, 0, 2]))]


def test_a_window_changes_only_the_rows_it_meets():
    layout = gru_lm.Layout(300, 4)
    weights = gru_lm.start_weights(layout, np.ones(layout.word_classes + 4), np.ones(300))
    before = {k: v.copy() for k, v in weights.items()}
    gru_lm.Trainer(weights, layout).fit([np.array([5, 5, 290, 0])])
    moved = {k: set(np.flatnonzero((weights[k] != before[k]).reshape(len(weights[k]), -1).any(axis=1))) for k in ("embed", "uw")}
    assert moved["embed"] <= {0, 5, 290} and {0, 5} <= moved["embed"]
    met = {c for c in layout.class_of(np.array([5, 290, 0]))}
    assert moved["uw"] == {i for c in met for i in range(layout.cuts[c], layout.cuts[c + 1])}


def test_blocks_of_logits_change_nothing(monkeypatch):
    layout = gru_lm.Layout(200, 4, np.arange(200, 0, -1))
    weights = gru_lm.start_weights(layout, np.ones(layout.word_classes + 4), np.ones(200))
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 204, n) for n in (90, 1, 0, 40, 333)]
    results = []
    for block, lanes in ((1, 2), (7, 3), (1 << 20, 512)):
        monkeypatch.setattr(gru_lm, "BLOCK", block)
        monkeypatch.setattr(gru_lm, "SCORE_LANES", lanes)
        fitted = {k: v.copy() for k, v in weights.items()}
        gru_lm.Trainer(fitted, layout).fit(docs, lanes=4)
        results.append((gru_lm.score_documents(weights, layout, docs), gru_lm.flatten(fitted)))
    for scores, flat in results[1:]:
        assert np.allclose(scores, results[0][0], rtol=1e-4) and np.allclose(flat, results[0][1], atol=3e-3)


def test_probabilities_add_up():
    layout = gru_lm.Layout(120, 4)
    weights = gru_lm.start_weights(layout, np.arange(1, layout.word_classes + 5), np.arange(120))
    every = gru_lm.score_documents(weights, layout, [np.array([7, t]) for t in range(124)])
    first = gru_lm.score_documents(weights, layout, [np.array([7])])
    assert abs((10 ** (every - first)).sum() - 1) < 1e-4
    long = np.arange(300) % 124
    parts = gru_lm.score_documents(weights, layout, [long, long[:100], long[:1]])
    assert abs(parts[0] - gru_lm.score_documents(weights, layout, [long])[0]) < 1e-3 and parts[2] > parts[1] > parts[0]


def plain_score(w, layout, doc):
    """One token after the other, in double precision."""
    d, h, last, total = gru_lm.STATE, np.zeros(gru_lm.STATE), 0, 0.0

    def share(u, b, rows, row):
        x = w[u][rows] @ h + w[b][rows]
        return x[row - rows.start] - x.max() - np.log(np.exp(x - x.max()).sum())

    for t in doc:
        x, g = w["embed"][last] @ w["wx"] + w["b"], h @ w["wh"]
        z, r = (1 / (1 + np.exp(-x[k : k + d] - g[k : k + d])) for k in (0, d))
        new = np.tanh(x[2 * d :] + r * g[2 * d :])
        h, last = (1 - z) * new + z * h, t
        c = int(layout.class_of(np.array([t]))[0])
        group = int(np.searchsorted(layout.group_cuts, c, "right")) - 1
        total += share("wg", "bg", slice(0, len(layout.group_cuts) - 1), group)
        total += share("wc", "bc", slice(*layout.group_cuts[group : group + 2]), c)
        if t < layout.words:
            total += share("uw", "bw", slice(*layout.cuts[c : c + 2]), t)
    return total / math.log(10)


def test_scores_equal_a_plain_loop():
    layout = gru_lm.Layout(150, 4, np.arange(150, 0, -1), np.array([9, 1, 0, 400]))
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 154, n) for n in (0, 300, 1, 7, 129, 64, 2)]
    weights = gru_lm.start_weights(layout, np.arange(1, layout.word_classes + 5), np.arange(150))
    for factor in (1, 3, 400):  # 400: exponentials of the logits as they are would pass single precision
        w = {k: v * np.float32(factor) if k in ("wg", "wc", "uw") else v for k, v in weights.items()}
        expected = [plain_score({k: v.astype(np.float64) for k, v in w.items()}, layout, doc) for doc in docs]
        assert np.allclose(gru_lm.score_documents(w, layout, docs), expected, rtol=2e-3, atol=1e-3)
        trained = {k: v.copy() for k, v in w.items()}
        gru_lm.Trainer(trained, layout).fit(docs)
        assert all(np.isfinite(v).all() for v in trained.values())


def test_a_token_meets_few_logits():
    counts = 10**7 / np.arange(1, 14_673)
    layout = gru_lm.Layout(len(counts), 30, counts, np.full(30, counts.sum() / 70))
    every = np.concatenate((np.add.reduceat(counts, layout.cuts[:-1]), layout.shape_counts))
    share = every / every.sum()
    logits = len(layout.group_cuts) - 1
    logits += sum(share[a:b].sum() * (b - a) for a, b in zip(layout.group_cuts[:-1], layout.group_cuts[1:]))
    logits += (share[: layout.word_classes] * np.diff(layout.cuts)).sum()
    assert logits < 90  # all classes, and the words of one, were more than 170


def test_lanes_take_whole_documents_evenly(monkeypatch):
    monkeypatch.setattr(gru_lm, "SCORE_LANES", 3)
    lanes = gru_lm._lanes(np.array([1, 8, 0, 5, 5, 4, 1]))
    assert sorted(i for held in lanes for i in held) == list(range(7))
    assert [sum([1, 8, 0, 5, 5, 4, 1][i] for i in held) for held in lanes] in ([9, 9, 6], [9, 8, 7])


def test_kept_numbers_are_those_of_the_texts(spark):
    rows = [(1, "a b a"), (2, None), (3, "\u00e9t\u00e9 b"), (4, ""), (5, "x " * 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    counts = lm_scoring.Counts.of(lm_scoring.word_counts(docs))
    got = lm_scoring.encode(docs, F.col("doc_id") != 5, counts).orderBy("doc_id").collect()
    numbers = [np.frombuffer(bytes(r["ids"]), np.int32).tolist() for r in got]
    assert [len(x) for x in numbers] == [r["n_tokens"] for r in got] == [4, 1, 3, 1, 10]
    assert numbers[0][0] == numbers[0][2] != numbers[0][1] == numbers[2][1] and {x[-1] for x in numbers} == {0}
    assert [r["trained"] for r in got] == [True] * 4 + [False] and all(r["rare"] == [] for r in got)
    column = pa.array([bytes(r["ids"]) for r in got])
    assert [x.tolist() for x in lm_scoring._documents(column.slice(1, 3))] == numbers[1:4]


def test_scores_beat_counts_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = lm_scoring.score(docs, ~held).collect()
    rows = {r["doc_id"]: (r["text"] or "") for r in docs.collect()}
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(table)), None] for d, t in rows.items()}
    held_out = {d for d in rows if zlib.crc32(str(d).encode()) % 7 == 2}
    counts = Counter(w for d in rows if d not in held_out for w in tokens[d])
    n, v = sum(counts.values()), len(counts)
    better = 0
    for r in got:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["trained"]) == (len(own), sum(counts[w] > 0 for w in own), n, r["doc_id"] not in held_out)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        better += (r["score"] - base) * (r["doc_id"] in held_out)
    assert better > 0


def test_rare_words_are_counted_beyond_the_head(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 8)
    monkeypatch.setattr(lm_scoring, "MODEL_WORDS", 5)
    test_scores_beat_counts_held_out(spark)


def test_every_training_document_reaches_the_weights(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "START_DOCS", 2)
    ids = spark.range(400).select(F.col("id").alias("doc_id")).where("pmod(xxhash64(3, doc_id), 16) <> 0").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = [r["doc_id"] for r in ids.limit(12).collect()]  # the first two make the sample
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(90))) for i in ids]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    counts = lm_scoring.Counts.of(lm_scoring.word_counts(frame(rows)))
    plain = lm_scoring.fit(frame(rows), counts)
    for k in range(2, len(rows)):
        other = [(i, t[::-1] if j == k else t) for j, (i, t) in enumerate(rows)]
        assert not np.array_equal(plain, lm_scoring.fit(frame(other), counts))


def test_words_with_weights_grow_with_the_distinct_words(spark):
    table = spark.range(400_000).selectExpr("id AS h", "0 AS k", "1L AS c")
    assert lm_scoring.Counts.of(table).layout.words == 8 * math.isqrt(400_000) > lm_scoring.MODEL_WORDS
    assert lm_scoring.Counts.of(table.limit(4000)).layout.words == lm_scoring.MODEL_WORDS


def test_scores_of_odd_rows(spark):
    got = lm_scoring.score(documents(spark, clash=True), F.col("doc_id") != 7)
    assert ids_of(got) == ALL_IDS
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[3]["n_tokens"] == by[4]["n_tokens"] == by[5]["n_tokens"] == 1 and not by[7]["trained"] and not by[None]["trained"]
    untrained = lm_scoring.score(documents(spark), F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == r["base_score"] for r in untrained) and len(untrained) == len(ROWS)
    assert lm_scoring.score(empty(spark), F.lit(True)).count() == 0


# --- pipeline --------------------------------------------------------------------------


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    from test_dedup import groups

    from millrace.llm import line_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert kept.columns == columns
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & bad) <= 0.1 * len(bad) and len({r["doc_id"] for r in docs.collect()} - bad - ids) <= 0.2 * docs.count()
    kept.write.parquet(str(tmp_path / "a"))
    kept = spark.read.parquet(str(tmp_path / "a"))
    lined = corpus_pipeline.STAGES[1][1](spark, kept, SF)
    assert lined.columns == columns and lined.count() == len(ids)
    cleaned = {r["doc_id"]: r["text"] for r in lined.collect()}
    assert cleaned == {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(kept).collect()}
    first = {d for d, (_, c) in groups(list(cleaned.items()), 5, 80).items() if c == d}
    third = corpus_pipeline.STAGES[2][1](spark, lined, SF)
    assert {r["doc_id"] for r in third.collect()} == first
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in contaminated([(d, cleaned[d]) for d in first], items)}
    final = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in final.collect()} == first - leaks
    assert all(r["text"] == cleaned[r["doc_id"]] and r["n_tokens"] == len(r["input_ids"]) for r in final.collect())


def test_stages_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (10, 0)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (documents(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path))
            rows.write.parquet(str(tmp_path / f"{name}{random.random()}"))
