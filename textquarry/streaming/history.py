"""Streams of turns: tool output is capped as it arrives, so the cached prefix never changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.context import capped_history


def read_turns(spark: SparkSession, path: str, schema: str = "conv_id long, turn long, role string, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def write_capped(turns: DataFrame, path: str, checkpoint: str, limit: int, tool_role: str = "tool") -> StreamingQuery:
    """Stateless, append only; the file sink and the checkpoint make it exactly-once."""
    return capped_history(turns, limit, tool_role).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def events_per_window(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type in tumbling windows, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
