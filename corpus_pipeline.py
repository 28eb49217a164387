"""Training-data pipeline over documents: language ID, line dedup, near-duplicate removal, benchmark decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontam, langid, lines, packing, simhash
from tracewright.llm.common import materialize, table

#: Least posterior probability of the predicted language; below it, as without any letter, a document is rejected.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language is recognised."""
    predicted = langid.predict(docs, langid.train(docs))
    return predicted.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that came before, here or in another document; documents that lose every line go."""
    kept = lines.dedup_lines(docs)
    whole = kept.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    return whole.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id in each group of near-duplicates: shingles' fingerprints within 4 bits, or 0.8 of the shingles of five words in common."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of binary length with their ids, from buckets of equal length."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), longest=1024, end_id=0)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: Hashing, naive Bayes and tokenizing are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
