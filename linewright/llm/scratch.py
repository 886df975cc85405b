"""Tables that cut a job's lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PREFIX = "linewright-scratch"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; the warehouse, which a cluster shares too, where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """Where this application's tables are."""
    return f"{shared_folder(spark)}/{_PREFIX}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; lost executors then cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids, or of array elements, that may be sent to every task: some 16 MB.
BROADCAST_ROWS = 1_000_000


def sent_if_small(stored_rows: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side of a join as a broadcast if it has at most so many rows, else as it is, to be shuffled."""
    return F.broadcast(stored_rows) if rows <= most else stored_rows


def without_ids(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """docs without the rows whose doc_id is in ids (doc_id); rows without a doc_id stay. The texts move only if the ids are many."""
    gone = stored(ids.select(F.col("doc_id").cast("long").alias("_gone_id")).distinct(), name)
    return docs.join(sent_if_small(gone, gone.count()), docs["doc_id"] == F.col("_gone_id"), "left_anti")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when no result of it is still being read."""
    delete(spark, own_folder(spark))
