"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, jaccard_join, mixing, quality_rules, token_files
from corvane.llm.common import new_dir, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have too few words and go; repeated rows stay or go together; other columns stay."""
    return quality_rules.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by 5-word shingles at Jaccard 0.8 or more, the one with the smallest id; null ids come last, and of rows alike one stays. Texts without words are linked with nothing but their own repeated rows."""
    return jaccard_join.first_of_groups(docs, width=5, num=80, den=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no segment of a benchmark item. Null and empty texts and items hold nothing and stay; repeated rows and null ids are judged row by row."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (weights 3, 1, 2 in turn, one and a half times the words, two epochs at most). Null is a source of its own, the last; null and empty texts have no words and aren't taken; repeated rows are documents of their own."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, max_epochs=2)


def token_index(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; the rows are what the files have of each document, in order of ids, null ids first. An empty mix gives no file and no row."""
    import public_tokenizers

    manifest = token_files.write_tokens(docs, new_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.checksums(token_files.read_rows(manifest))


STAGES = [
    ("quality_rules", good_quality),
    ("jaccard_join", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("mix_sources", mixed),
    ("token_files", token_index),
]

#: Alignment and tokenizing are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
