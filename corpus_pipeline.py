"""The corpus pipeline: STAGES applied one after the other to the table documents.

Each stage works on all that its predecessor kept and hands on the columns of documents; the last one
returns the packed pieces. Every stage's result is written to the shared folder and read again, so a
lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm import cascade, decontam, line_dedup, packing, simhash
from inkmill.llm.common import materialize
from inkmill.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return cascade.apply_rules(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are taken out of the texts; n_chars follows the text. A text that loses all lines stays, empty."""
    clean = line_dedup.dedup_lines(docs, count_col=None)
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns]
    return clean.select(columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return simhash.near_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences."""
    return packing.op3(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("simhash near-dedup", near_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: SQL can express neither XXH64 nor the tokenizer, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
