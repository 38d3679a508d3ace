"""Training text from raw documents: toxic texts and near copies go, secrets are masked, sources
are mixed to their targets, and the mix is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next one's ``docs``; all but the last keep the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import jaccard, mixing, packing, secrets, toxicity
from riskloom.runtime import pin


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not call toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: runs of five words, similarity 0.8 or more."""
    return jaccard.drop_near_copies(docs, k=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, to bring their sources to the target weights."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage), ("ngram_jaccard", jaccard_stage), ("secrets", secrets_stage),
    ("mixing", mixing_stage), ("packing", packing_stage),
]

#: a fitted classifier, spans in texts and token ids are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the table is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
