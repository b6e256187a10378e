"""A training-data pipeline: five stages over documents, each written and read again.

Language ID keeps documents in a learned language, the n-gram Jaccard join keeps one
document of each group of near copies, decontamination drops documents that leak a
benchmark item, secret scans replace what they find by a mark, and BPE encodes what is
left. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillward.llm import bpe_automaton, decontaminate, language_id, ngram_join, secret_scan
from quillward.llm.common import Scratch, ready, table
from quillward.llm.queries import vocabulary_path


#: Score below which a predicted language is no better than a guess.
LEAST_LANGUAGE = 0.3


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is one of the learned ones and scores LEAST_LANGUAGE; texts without a letter go."""
    return language_id.keep_languages(spark, docs, least=LEAST_LANGUAGE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every component of five-word shingles, similarity 0.8; rows with a null id stay."""
    return ngram_join.keep_first(spark, docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.drop_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; n_chars follows the text."""
    return secret_scan.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with counts and digests."""
    return bpe_automaton.encode_decode(spark, docs, vocabulary_path())


STAGES = [("language_id", by_language), ("ngram_join", one_of_each_group), ("decontaminate", without_benchmark), ("secret_scan", without_secrets), ("bpe", encoded)]

#: Language ID and BPE are not expressible in SQL; a brute-force version tests the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is a written table."""
    docs = table(ready(spark), sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
