"""Stored tables below the shared checkpoint folder: lineage ends there, and lost executors recompute nothing before."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where that is unset and Spark runs on one machine, a temporary folder serves; on a cluster the setting is needed."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.wayfold.tables", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("spark.wayfold.tables", base)
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, rows: int = 10_000) -> DataFrame:
    """``df`` (read twice: it should be a table, or little work) dealt to as many tasks as its number of rows wants, about ``rows`` each.

    For what costs much a row: neither the size of files nor that of shuffled data says how much work they hold.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def numbered(df: DataFrame, name: str, *order: str, ready: bool = False) -> DataFrame:
    """``df`` with dense numbers from 1 in ``order``.

    Rows are range-partitioned and stored in order; only a row count for each file comes together, so no task
    sees all rows.  Finding the ranges reads ``df`` once more, so it is stored before, unless it is ``ready``.
    """
    once = df if ready else stored(df)
    ranked = stored(once.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = sorted((r["__part"], r["n"], r["low"]) for r in ranked.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("low")).collect())
    starts, total = [], 0
    for part, n, low in counts:
        starts.append((part, total + 1 - low))
        total += n
    shift = df.sparkSession.createDataFrame(starts, "__part int, __shift long")
    return ranked.join(F.broadcast(shift), "__part").select(*df.columns, (F.col("__at") + F.col("__shift")).alias(name))
