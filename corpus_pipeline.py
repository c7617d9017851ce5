"""Corpus pipeline: from raw documents to token ids, in five stages over all documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result into the shared folder and reads it back for the next, so a lost executor costs one
stage at most; what a stage wrote for itself, and the result before it, are removed then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, language, ngram_join, suffix_dedup
from docloom.llm.shared import scratch, table, unwritten, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without letters."""
    return language.accepted(docs, language.learn(language.learned_part(docs)))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles, from 0.8 on, the one with the smallest doc_id stays."""
    return ngram_join.first_of_classes(docs, words=5, least=(80, 100))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a string of 200 bytes that starts twice is cut from the texts; all documents stay."""
    return suffix_dedup.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows are cut from the texts; all documents stay."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="spans")
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of its text, and the SHA-256 of the bytes that these decode to."""
    return bpe.encode(docs, cache=150_000)  # leaves the workers room for what the JVM took in the other stages


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can't express the stages; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, kept=True)
        unwritten(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
