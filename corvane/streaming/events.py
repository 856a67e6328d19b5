"""Structured Streaming over an event log: counts by day, distinct events, latest state per user.

Every function takes and gives a streaming DataFrame (a batch one works too). State is bounded by the
watermark: what is older than ``late`` is closed and leaves the state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A stream over the event table's files, ``files`` a batch."""
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Tumbling days by type."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def sliding_counts(events: DataFrame, size: str = "1 day", slide: str = "6 hours", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Sessions of a user: events with at most ``gap`` between them."""
    s = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(s.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest_per_key(events: DataFrame, values: tuple[str, ...] = ("event_type", "value")) -> DataFrame:
    """The latest event of each user, by time and id, as it stands after every batch (output mode update or complete).

    The state is one row a user; it is kept without a watermark, as a user may come back at any time.
    """
    last = F.max(F.struct("ts", "event_id", *values)).alias("m")
    return events.groupBy("user_id").agg(last).select("user_id", *[F.col(f"m.{c}").alias(c) for c in ("ts", "event_id", *values)])


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, once, into a table ``name`` in memory (small results, tests)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
