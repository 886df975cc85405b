"""The queries of this package over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_quality, metric_join, oracle, packing, pii_boost, secret_scan, token_codec, url_rules, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_verdicts(_table(spark, sf_dir, "documents"))


def op2_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.digest(pii_boost.find_personal_data(_table(spark, sf_dir, "documents")))


def op3_host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_context_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.read_ids(token_codec.write_ids(_table(spark, sf_dir, "documents")))


def op8_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs)).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_rules.judge_urls(pages, url_rules.labelled_pages(pages, _table(spark, sf_dir, "labels")))


def op10_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_frequency, op2_boosted_candidates, op3_host_wrappers, op4_metric_join, op5_cgk_decontamination, op6_exact_complement_packing,
        op7_context_mixing_coder, op8_language_hierarchy, op9_url_association_rules, op10_assignment_secrets,
    )
}

#: The others rest on models, tokenizers, edit distances, parsers or packing, which SQL cannot give whole; tests hold
#: them against brute force, round trips and held-out accuracy.
ORACLE_SQL = {"op1_line_frequency": oracle.LINE_FREQUENCY, "op4_metric_join": oracle.METRIC_JOIN, "op9_url_association_rules": oracle.URL_RULES}
