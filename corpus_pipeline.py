"""A corpus pipeline over documents: five stages, each one operator of linewright.llm.

Each stage works on all that the one before kept, and its result is written as
Parquet and read again.  All but the last return the columns of documents.

quality: rejected documents go, boilerplate lines leave the text.
near_duplicates: of each group the document with the smallest doc_id stays.
decontamination: documents that hold a benchmark item go.
secrets: found secrets are masked in the text.
packing: one row for each piece of a document, with its sequence and offset.

Defined results: null, empty and blank texts are rejected by the first stage; rows that are equal in
doc_id, source and text get one answer, and near_duplicates leaves one row of a doc_id; rows
without a doc_id are judged by their text alone: quality can reject them, the stages that name
documents by their id let them pass, the last two take them as they are; other columns, whatever their names, go through
all stages but the last; an empty table gives an empty one at every stage; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linewright.llm import decontaminate, line_quality, metric_join, packing, secret_scan
from linewright.llm.scratch import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.clean_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return metric_join.keep_first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the stages' methods; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
