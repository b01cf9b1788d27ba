"""Incremental import: a stream's first row a key stays, kept as state by key, so a batch costs what it holds and not what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.text import normalize_house, normalize_import, normalize_street

ADDRESS = "city string, street string, house string, lat double, lon double, seq long"
KEY = ["city_norm", "street_norm", "house_norm"]
#: Keeps state in files beside the executors' memory; for streams with more keys than fit there.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_arrivals(stream: DataFrame, key: list[str], seq: str, payload: list[str]) -> DataFrame:
    """One row a key, for good: of the first batch that has the key the row with the smallest ``seq``.

    A streaming aggregation holds a row for each key.  A batch's time is the order of arrival, so the row that is held never
    changes; it is sent on (mode ``update``) by the batch that brought it and not by later ones that see the key again.
    """
    dated = stream.withColumn("__arrived", F.current_timestamp())
    kept = dated.groupBy(*key).agg(F.min(F.struct("__arrived", seq, *payload)).alias("__first"), F.max("__arrived").alias("__last"))
    return kept.where(F.col("__first.__arrived") == F.col("__last")).select(*key, *(f"__first.{c}" for c in [seq, *payload]))


def append_first_arrivals(stream: DataFrame, key: list[str], seq: str, payload: list[str], table: str, checkpoint: str):
    """Start a query that appends the first row of each new key to the Parquet table at ``table``, available data first.

    A batch is written below its own number, so a batch that runs again after a failure replaces itself.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return first_arrivals(stream, key, seq, payload).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def address_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Address rows (ADDRESS) of Parquet files as they come into a folder."""
    return spark.readStream.schema(ADDRESS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_addresses(stream: DataFrame, table: str, checkpoint: str):
    """Start a query that appends the addresses (ADDRESS) that no batch has brought before."""
    keyed = stream.withColumns({"city_norm": normalize_import(F.col("city")), "street_norm": normalize_street(F.col("street")), "house_norm": normalize_house(F.col("house"))})
    return append_first_arrivals(keyed, KEY, "seq", ["city", "street", "house", "lat", "lon"], table, checkpoint)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each key and event-time window; rows later than ``late`` behind the newest are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
