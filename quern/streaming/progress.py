"""Structured Streaming view of the job-event log. Additive: the reference polls; results equal the batch form of L7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over a folder of Parquet event files."""
    return spark.readStream.schema(schema).parquet(path)


def latest_states(events: DataFrame, key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """The newest event per key, repeats within the watermark dropped: state is one row per key."""
    e = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return e.groupBy(key).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"), F.count("*").alias("n")).select(key, F.col("m.event_type").alias("event_type"), F.col("m.ts").alias("ts"), "n")


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window; late ones beyond the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_to_table(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Process all that is there into an in-memory table (tests and reports)."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
