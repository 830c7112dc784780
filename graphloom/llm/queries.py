"""The registered queries: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontam, embed_dedup, html_text, langid, packing, secrets, setsketch, shared, substring, suffix_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ALLOW = (("org", "/"), ("com", "/fr/"))
BLOCK = (("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/"))


def op2_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), ALLOW, BLOCK)


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_table(spark, sf_dir, "documents"), length=20)


def op6_piece_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_window_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op8_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"), length=400)


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_string_tiling": op1_string_tiling,
    "op2_bloom_cascade": op2_bloom_cascade,
    "op3_nn_descent": op3_nn_descent,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_suffix_automata": op5_suffix_automata,
    "op6_piece_unigrams": op6_piece_unigrams,
    "op7_window_entropy": op7_window_entropy,
    "op8_layout_text": op8_layout_text,
    "op9_suffix_radix": op9_suffix_radix,
    "op10_setsketch": op10_setsketch,
}
ORACLE_SQL: dict[str, str] = {
    "op2_bloom_cascade": url_filter.oracle_sql(ALLOW, BLOCK),
    "op7_window_entropy": secrets.oracle_sql(),
}
