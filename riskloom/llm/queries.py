"""The registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import jaccard, lexical, licenses, lines, merkle, mixing, packing, secrets, threads, tokencounts, toxicity, warc, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op1_mix_sources": mixing.SQL, "op6_warc": warc.SQL, "op11_lexical_search": lexical.SQL, "op12_merkle_manifest": merkle.SQL}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _over(name: str, table: str):
    def add(operator: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: operator(read(spark, folder, table))
        return operator

    return add


_over("op1_mix_sources", "documents")(mixing.mixing_report)
_over("op2_pack_sequences", "documents")(packing.pack)


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(read(spark, folder, "documents"), read(spark, folder, "labels"))


QUERIES["op3_toxicity"] = _labelled
_over("op9_secrets", "documents")(secrets.secrets_report)
_over("op4_ngram_jaccard", "documents")(jaccard.near_report)
_over("op5_winnowing", "documents")(winnowing.edited_report)
_over("op10_line_cleaning", "documents")(lines.quality_report)
_over("op6_warc", "pages")(warc.archive_report)
_over("op7_license_scan", "documents")(licenses.license_report)
_over("op8_quotation_links", "conversations")(threads.link_quotations)


def _searched(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


QUERIES["op11_lexical_search"] = _searched
_over("op12_merkle_manifest", "documents")(merkle.tamper_report)
_over("op13_token_counts", "documents")(tokencounts.count_report)
