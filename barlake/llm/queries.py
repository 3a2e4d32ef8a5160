"""Queries of the corpus operators, p8 to p10, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import encode, levels, mixing
from barlake.session import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: what the ids of each text say again, as a digest."""
    return encode.decode_ids(encode.encode_texts(table(spark, d, "documents"))).select("doc_id", F.md5("text").alias("digest"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return levels.demanding(table(spark, d, "documents"), table(spark, d, "level_labels"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return levels.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p8_ids, p8_decoded, p9_found, p9_report, p9_mixture, p10_found, p10_levels)}

SQL: dict[str, str] = {"p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"}
