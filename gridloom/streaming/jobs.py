"""Structured Streaming forms of the additive and order-free raster steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def trigger_averages(samples: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Mean channels per trigger and window of a sample stream (ts, trigger, c0, c1); late samples are dropped."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", window), "trigger").agg(F.avg("c0").alias("c0"), F.avg("c1").alias("c1"), F.count("*").alias("n"))


def running_bins(frames: DataFrame, size: int) -> DataFrame:
    """Growing bin sums of a frame stream (row, col, v), for update mode."""
    cell = lambda c: F.floor(F.col(c) / size).cast("bigint")
    return frames.groupBy(cell("row").alias("brow"), cell("col").alias("bcol")).agg(F.sum("v").alias("total"), F.count("*").alias("n_frames"))


def live_device_map(device_map: DataFrame) -> DataFrame:
    """The fused map of a device-map stream: largest value, its theta and the thetas seen, by cell."""
    used = device_map.filter("integrated > 0")
    best = F.struct("integrated", -F.col("ord"))
    return used.groupBy("brow", "bcol").agg(F.max("integrated").alias("max_intensity"), F.max_by("theta", best).alias("argmax_theta"), F.size(F.collect_set("theta")).cast("bigint").alias("n_theta"))


def event_rates(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events per type and tumbling or sliding window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("n"))


def merge_latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the latest by order; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_p", place).filter("_p = 1").drop("_p", "_new")


def ingest(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run upsert on every micro-batch of what is there now, then stop."""
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(result: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Run a streaming result over what is there now into an in-memory table, for reading back."""
    return result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
