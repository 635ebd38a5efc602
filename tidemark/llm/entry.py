"""Registered queries of the training-data operators: one per operator, over whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embed_dedup, warc
from .common import table
from .decontaminate import benchmark_matches
from .html_cut import extract_content
from .ngram_join import ngram_classes
from .packing import pack_documents
from .pii import pii_report
from .quality_gam import accepted
from .token_rollup import documents_rollup
from .word_lm import word_lm_scores


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_rollup(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_revisits(warc.crawl_of_pages(table(spark, sf_dir, "pages")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_content(table(spark, sf_dir, "pages"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_lm_scores(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_classes(table(spark, sf_dir, "embeddings"))


def near_copies_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over each vector, a copy and three perturbed ones, so that SQL sees links and copies."""
    return embed_dedup.near_duplicate_classes(embed_dedup.with_copies(table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_gam": op1_quality_gam,
        "op2_token_rollup": op2_token_rollup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_pii": op4_pii,
        "op5_revisit_resolution": op5_revisit_resolution,
        "op6_html_extraction": op6_html_extraction,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
        "near_copies_of_vectors": near_copies_of_vectors,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_revisit_resolution": warc.ORACLE,
        "op10_embedding_near_dedup": embed_dedup.ORACLE,
        "near_copies_of_vectors": embed_dedup.COPIES_ORACLE,
    }
