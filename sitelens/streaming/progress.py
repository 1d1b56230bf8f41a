"""Run progress as a stream: the call log's events summed by run while they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def run_state(events: DataFrame) -> DataFrame:
    """Calls, failures and last event time of each run; works on streams and tables alike."""
    return events.groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("calls"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("failed"), F.max("ts").alias("last"))


def follow(spark: SparkSession, folder: str, name: str, checkpoint: str):
    """Starts a query over a folder of event files that keeps run states in an in-memory table of that name."""
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    return run_state(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
