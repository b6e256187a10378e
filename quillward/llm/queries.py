"""One query per operator of this subpackage, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillward.llm import bpe_automaton, decontaminate, html_extract, language_id, license_scan, lm_score, media, ngram_join, piece_prefix, prefix_trie, quality, secret_scan, source_audit
from quillward.llm.common import ready, table

#: The public vocabularies of op4 and op12; parameters there.
VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(spark, table(spark, sf_dir, "documents")).drop("matches")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(ready(spark), sf_dir, "documents")).drop("hits")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(spark, table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_decode(spark, table(spark, sf_dir, "documents"), vocabulary_path(), keep_ids=False)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(spark, table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark, table(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(spark, table(spark, sf_dir, "documents"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(spark, table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_prefix.encode_decode(spark, table(spark, sf_dir, "documents"), vocabulary_path(PIECES), keep_ids=False)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark, table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_secret_scan, op3_lm_score, op4_bpe, op5_media, op6_quality, op7_decontaminate, op8_language_id, op9_html, op10_ngram_join, op11_source_audit, op12_pieces, op13_prefix_trie)
}


def oracles() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op2_secret_scan": secret_scan.oracle(), "op11_source_audit": source_audit.oracle(), "op13_prefix_trie": prefix_trie.oracle()}
