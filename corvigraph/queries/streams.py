"""Event windows, as batch and as stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from ..registry import query
from ..sources.tables import table
from ..streaming import windows as W


def _out(df, *keys):
    return df.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), *keys, "n", F.round("total", 4).alias("total"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, base):
    return _out(W.windowed(table(spark, base, "events"), ["event_type"], "1 hour"), "event_type")


@query("SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1, 2")
def sliding_window(spark, base):
    return _out(W.windowed(table(spark, base, "events"), ["event_type"], "1 hour", "30 minutes"), "event_type")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM s GROUP BY user_id, s")
def session_window(spark, base):
    return W.sessions(table(spark, base, "events"), ["user_id"], "30 minutes").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_totals(spark, base):
    """The events read as a stream, deduplicated by id within a watermark, then summed."""
    scratch = Scratch(spark, "stream")
    folder = scratch.path("in")
    events = table(spark, base, "events")
    events.write.parquet(folder)
    out = scratch.path("out")
    stream = W.with_lateness(W.read_stream(spark, folder, events.schema), "40 days").dropDuplicatesWithinWatermark(["event_id"])
    W.run_to_end(stream, scratch.path("state"), out)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
