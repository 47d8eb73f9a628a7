"""Queries over whole tables for the training-data operators, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, extraction, langid, media, oracles, packing, pii, sharding, simhash, substring, toxicity
from .common import table


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), packing.vocabulary_path())
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("bucket"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": _documents(substring.remove_duplicates),
    "op2_toxicity": op2_toxicity,
    "op3_pii": _documents(pii.digest),
    "op4_simhash": _documents(simhash.near_duplicates),
    "op5_decontamination": op5_decontamination,
    "op6_packing": op6_packing,
    "op7_media": _documents(media.media_features),
    "op8_html_extraction": op8_html_extraction,
    "op9_sharding": _documents(sharding.shard_documents),
    "op10_language_id": _documents(langid.identify),
}

#: The other queries need tokens, models or archives that SQL lacks; tests/llm
#: holds each against a plain version of its contract.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op3_pii": oracles.PII,
    "op4_simhash": oracles.SIMHASH,
    "op5_decontamination": oracles.DECONTAMINATION,
    "op9_sharding": oracles.SHARDING,
}
