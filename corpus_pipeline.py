"""The corpus pipeline: documents, stage by stage, each written as Parquet and read again by the next.

Stages keep all columns of documents, any extra ones too; the last adds mix_copies, how often the mix
takes the document. Every stage judges rows by their own text: repeated rows, rows that share a doc_id
and rows without one are no exception but where its docstring says so. Empty tables and null texts pass through
every stage; the mix takes no text without words. Texts of any length are read in whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkgraph.llm import decontam, linededup, mixing, neardup, quality
from linkgraph.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go; equal texts fare alike."""
    return quality.accepted_rows(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated windows of lines are cut from the texts; the smallest doc_id keeps its own, and rows without doc_id keep theirs."""
    return linededup.dedup_lines(docs).drop("_lines")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8) stays, of the smallest doc_id; rows without doc_id or words all stay."""
    return neardup.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a passage of the benchmark go, whatever their doc_id."""
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes, with how often; ties in the queue go by the shuffle."""
    return mixing.mixed_rows(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_stage), ("benchmark", benchmark_stage), ("mixing", mixing_stage)]

#: A trained model and fingerprints are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
