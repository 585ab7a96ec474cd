"""The text operators as queries over the driver's tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regiolith.llm import backoff, byte_bpe, decontaminate, html_extract, minhash, quality, suffix_array, suffix_tree, toxicity
from regiolith.llm import license_scan as licenses
from regiolith.llm.common import prepare, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(prepare(spark), sf_dir, "documents"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.repeated_words(table(prepare(spark), sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(prepare(spark), sf_dir, "documents")).drop("perplexity", "band_low", "band_high")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_bytes(table(prepare(spark), sf_dir, "documents")).drop("runs")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.round_trip(table(prepare(spark), sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each document for each benchmark item that it holds: doc_id, item_id, word, distance, similarity."""
    return decontaminate.matches(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(prepare(spark), sf_dir, "pages"))


def op9_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))


def op10_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(table(prepare(spark), sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_suffix_tree, op3_quality_rules, op4_suffix_array, op5_byte_bpe, op6_decontaminate, op7_toxicity, op8_html_extract, op9_odd_sketches, op10_backoff_automaton)}

ORACLES: dict[str, str] = {"op1_license_scan": licenses.oracle(), "op2_suffix_tree": suffix_tree.oracle(), "op4_suffix_array": suffix_array.oracle(), "op9_odd_sketches": minhash.oracle()}
