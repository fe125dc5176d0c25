"""Windows over time; each works on a static or a streaming frame.

A stream needs a watermark (:func:`with_lateness`); rows later than that are dropped by Spark's rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_lateness(events: DataFrame, delay: str, time: str = "ts") -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def windowed(events: DataFrame, keys: list[str], size: str, slide: str | None = None, time: str = "ts", value: str = "value") -> DataFrame:
    """(start, keys, n, total) of tumbling windows, or sliding ones with ``slide``. Null times are in no window."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, keys: list[str], gap: str, time: str = "ts") -> DataFrame:
    """(start, keys, n) of sessions that end after ``gap`` without an event."""
    return events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def run_to_end(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, to Parquet, with its state in ``checkpoint``."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
