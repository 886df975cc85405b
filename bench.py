"""Seconds of the headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = ("flagship", "lines_scan", "category_scores", "context_selection", "batch_context", "pair_checks", "check_fix_report", "batch_prompts", "response_parsing", "characters", "bio_entities", "name_clusters", "glossary_conflicts", "resume_join")


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("linewright-bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from linewright.plans import catalog

    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # starts the executor threads
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
