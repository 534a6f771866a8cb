"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import (
    bpe, chunk_dedup, decontaminate, html_text, line_dedup, lm_scoring, mil_classifier, ngram_join, phrases, simhash_ring, syncmers, warc,
    word_runs,
)

QUERIES = {}
ORACLES = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(_table(spark, sf_dir, "documents"), size=3, percent=90)


QUERIES["op3_ngram_join"] = op3_ngram_join
ORACLES["op3_ngram_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
                      ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sets AS (SELECT DISTINCT doc_id, g FROM grams),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b
          WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM ends UNION SELECT r.doc_id, e.b FROM reach r JOIN ends e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)
"""


def in_fold(doc_id, folds: int, fold: int):
    """Whether the crc32 of an id's text falls in a fold; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


QUALITY_THRESHOLD = 0.3


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = mil_classifier.fit(docs, labels.where(~in_fold(F.col("doc_id"), 5, 0)))
    return mil_classifier.score(docs.select("doc_id", "text"), model).select(
        "doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES["op5_quality_classifier"] = op5_quality_classifier


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # distinct sites alone decide; in the pipeline copied texts are left whole for the stage after it
    cleaned = line_dedup.remove_boilerplate(_table(spark, sf_dir, "documents"), min_texts=1)
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


QUERIES["op1_line_dedup"] = op1_line_dedup
ORACLES["op1_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(parts) AS raw, generate_subscripts(parts, 1) AS place
  FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents)),
trimmed AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM lines),
common AS (SELECT line FROM trimmed WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
marked AS (SELECT t.doc_id, t.raw, t.place, c.line IS NOT NULL AS gone FROM trimmed t LEFT JOIN common c USING (line))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.raw, chr(10) ORDER BY m.place) FILTER (WHERE NOT gone), '') END AS text,
       count(m.raw) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id, d.text
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start_word")


QUERIES["op7_decontamination"] = op7_decontamination
ORACLES["op7_decontamination"] = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
items AS (SELECT item_id, w, len(w) AS n_words, least(5, len(w)) AS g FROM iw WHERE len(w) > 0),
ig AS (SELECT item_id, n_words, g, array_to_string(w[p + 1 : p + g], ' ') AS h
       FROM (SELECT *, unnest(range(0, n_words - g + 1)) AS p FROM items)),
dg AS (SELECT doc_id, n, g, p, array_to_string(w[p + 1 : p + g], ' ') AS h
       FROM (SELECT doc_id, w, len(w) AS n, g, unnest(range(0, len(w) - g + 1)) AS p
             FROM dw, (SELECT DISTINCT g FROM items) WHERE len(w) >= g)),
hits AS (SELECT DISTINCT d.doc_id, d.n, i.item_id, i.n_words, i.g, d.p FROM dg d JOIN ig i ON d.g = i.g AND d.h = i.h),
windows AS (SELECT DISTINCT doc_id, n, item_id, n_words, g, s
            FROM (SELECT *, unnest(range(greatest(0, p - (n_words - g)), greatest(0, least(p, n - n_words)) + 1)) AS s FROM hits)),
wc AS (SELECT w.doc_id, w.n, w.item_id, w.s, d.h, count(*) AS c
       FROM windows w JOIN dg d ON d.doc_id = w.doc_id AND d.g = w.g AND d.p BETWEEN w.s AND w.s + w.n_words - w.g GROUP BY ALL),
ic AS (SELECT item_id, h, count(*) AS c FROM ig GROUP BY ALL),
shared AS (SELECT doc_id, n, item_id, s, CAST(sum(least(wc.c, ic.c)) AS BIGINT) AS shared FROM wc JOIN ic USING (item_id, h) GROUP BY ALL),
judged AS (SELECT doc_id, item_id, s, shared, least(n, n_words) + n_words - 2 * (g - 1) - shared AS total FROM shared JOIN items USING (item_id))
SELECT doc_id, item_id, shared / total AS similarity, CAST(s AS BIGINT) AS start_word
FROM judged WHERE 100 * shared >= 80 * total
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / total DESC, s) = 1
"""


TOKENIZER = "byte_bpe_50k.json"


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.shared_vocabulary(spark, public_tokenizers.path(TOKENIZER))
    docs = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    docs = bpe.decode(docs.drop("text"), vocabulary)
    return docs.select(
        "doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("input_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES["op10_bpe"] = op10_bpe


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES["op9_html_extraction"] = op9_html_extraction


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_index(spark, warc.write_archive(_table(spark, sf_dir, "pages")))


QUERIES["op6_warc"] = op6_warc


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold(F.col("doc_id"), 7, 2)
    scored = lm_scoring.score(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES["op8_lm_scoring"] = op8_lm_scoring


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.with_next(_table(spark, sf_dir, "documents"))


QUERIES["op4_document_fingerprints"] = op4_document_fingerprints


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op2_substring_dedup"] = op2_substring_dedup


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_ring.near_groups(_table(spark, sf_dir, "documents"), size=3, radius=3)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))).select("doc_id", "fingerprint", "component_id")


QUERIES["op11_simhash_dedup"] = op11_simhash_dedup


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), least=10, top=2000, percent=50)


QUERIES["op12_phrase_mining"] = op12_phrase_mining
ORACLES["op12_phrase_mining"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, w[i : i + size - 1] AS g
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, g, count(*) AS c FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(c) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE size > 1 AND c >= 10),
longer AS (
  SELECT lang, part, max(c) AS c
  FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS part, c FROM candidates WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT a.* FROM candidates a LEFT JOIN longer b ON b.lang = a.lang AND b.part = a.g
  WHERE a.size = 3 OR b.c IS NULL OR 100 * b.c < 50 * a.c),
cuts AS (
  SELECT k.lang, k.g, k.c AS a, x.c AS l, y.c AS r, cut, k.c::HUGEINT * k.c * 1000000 // (x.c::HUGEINT * y.c) AS score
  FROM (SELECT *, unnest(range(1, size)) AS cut FROM kept) k
  JOIN f x ON x.lang = k.lang AND x.g = k.g[1 : k.cut] JOIN f y ON y.lang = k.lang AND y.g = k.g[k.cut + 1 : k.size]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM scored)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def periodic_tails(docs: DataFrame) -> DataFrame:
    """Texts of every tenth document by the crc32 of its id, their words from some place on replaced by a period of words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    chosen = docs.withColumn("w", F.when(h % 10 == 0, words))
    n = F.nullif(F.size("w"), F.lit(0))
    at = (g % n).cast("int")
    period = (1 + F.floor((n - at) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", at + 1, period), F.ceil((n - at) / period).cast("int")))
    text = F.array_join(F.concat(F.slice("w", 1, at), F.slice(tail, 1, n - at)), " ")
    return chosen.withColumn("text", F.when(n > 0, text).otherwise(F.col("text"))).drop("w")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.with_runs(periodic_tails(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"), F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES["op13_periodic_runs"] = op13_periodic_runs
