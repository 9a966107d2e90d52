"""Event streams: windowed counts with late data, first events without duplicates, and idempotent partition writes.

The batch reports read the same events; these keep them current between runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def per_window(events: DataFrame, length: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(window, event_type, n, total): tumbling counts; what is later than ``lateness`` is dropped, and state is bounded by it."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_seen(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Each event once, however often it is delivered within ``lateness``."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def replace_days(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes batches by day. A batch that is run again writes the same files, so a restart repeats nothing."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumns({"day": F.to_date("ts"), "batch": F.lit(number)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
