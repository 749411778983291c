"""Event streams: latest status, windows, sessions. Each function takes a batch or a streaming DataFrame of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_status(events: DataFrame) -> DataFrame:
    """Per user the type and time of the last event and the number of events; the larger event_id wins among equal times."""
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("r")
    return events.groupBy("user_id").agg(last, F.count(F.lit(1)).alias("n")).select("user_id", F.col("r.event_type").alias("last_type"), F.col("r.ts").alias("last_ts"), "n")


def window_counts(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Events and sum of values per window and type; with ``late``, a watermark after which late events are dropped."""
    if late:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    per = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return per.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def once(events: DataFrame, late: str) -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of a user, ended by a pause of ``gap``."""
    per = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def hydrated(stored: DataFrame, live: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key out of stored and live rows of the same columns: the live ones win over the stored ones, the last by
    ``order`` among them.
    """
    rest = [c for c in stored.columns if c != key and c not in order]
    both = stored.withColumn("_live", F.lit(0)).unionByName(live.withColumn("_live", F.lit(1)))
    return both.groupBy(key).agg(F.max(F.struct("_live", *order, *rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in (*order, *rest)])
