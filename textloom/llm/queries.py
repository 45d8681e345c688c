"""The contract queries: thin digests of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import secrets, topk
from textloom.llm.common import new_path, table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import viterbi

    return viterbi.digests(table(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import records

    folder = new_path(spark, "token-files")
    return records.read(records.write(table(spark, sf_dir, "documents"), folder), folder)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import html

    return html.extract(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import transducer

    return transducer.token_counts(table(spark, sf_dir, "documents"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import quality

    return quality.quality(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import lm

    return lm.score(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_packing": op2_packing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_output": op4_token_output,
    "op5_html_extraction": op5_html_extraction,
    "op6_token_counts": op6_token_counts,
    "op7_exact_topk": op7_exact_topk,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_lm_scoring": op10_lm_scoring,
}
SQL: dict[str, str] = {"op1_secret_scans": secrets.oracle_sql(), "op7_exact_topk": topk.oracle_sql()}
