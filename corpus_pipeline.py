"""Raw documents to token ids: five stages, each on everything that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns the columns of ``documents``; the last one adds
the ids. Results are written as Parquet and read again, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import bpe, decontaminate, line_dedup, mil_classifier, ngram_join
from millrace.llm.queries import QUALITY_THRESHOLD, TOKENIZER, in_fold
from millrace.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at the threshold or above; the fold held out trains nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~in_fold(F.col("doc_id"), 5, 0))
    model = mil_classifier.fit(docs, labels)
    return mil_classifier.score(docs, model).where(F.col("score") >= QUALITY_THRESHOLD).drop("score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their boilerplate lines taken out and ``n_chars`` counted anew."""
    clean = line_dedup.remove_boilerplate(docs).drop("n_lines", "n_removed")
    return clean.withColumn("n_chars", F.length("text").cast("bigint"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of similar ones."""
    return ngram_join.keep_first(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, their number, and as ``text`` what they decode to."""
    import public_tokenizers

    vocabulary = bpe.shared_vocabulary(spark, public_tokenizers.path(TOKENIZER))
    encoded = bpe.encode(docs, vocabulary)
    return bpe.decode(encoded, vocabulary, out="text").withColumn("n_tokens", F.size("input_ids").cast("bigint"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

# A trained classifier decides in the first stage: no SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
