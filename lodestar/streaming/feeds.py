"""Streams: usage counters, change feeds that keep an index fresh, windows and sessions over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import IndexConfig, SCHEMAS
from ..sources.trees import ignored


def usage_counters(events: DataFrame) -> DataFrame:
    """Running counts and bytes a command, for output mode update or complete."""
    return events.groupBy("command").agg(F.count(F.lit(1)).alias("calls"), F.sum("bytes_served").alias("bytes_served"), F.sum(F.when(F.col("raw_baseline").isNull(), 1).otherwise(0)).alias("unmeasured"))


def windowed(events: DataFrame, ts: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts in windows of ts; events later than `late` are passed over."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), *keys, "events")


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def read_usage(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMAS["usage_events"]).json(folder)


def watch(spark: SparkSession, folder: str, refresh: Callable[[DataFrame, int], None], checkpoint: str, every: str = "500 milliseconds", config: IndexConfig | None = None) -> StreamingQuery:
    """Call refresh(paths, batch) with the distinct paths of each batch of change notices (JSON: path) in a folder.

    A batch gathers what came within `every`; ignored paths are dropped; a batch without paths calls nothing. Offsets
    are in `checkpoint`, so that a restarted watcher goes on where it stopped.
    """
    config = config or IndexConfig()
    notices = spark.readStream.schema("path string").json(folder)

    def run(batch: DataFrame, n: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().collect()]  # one batch of edits
        kept = [(p,) for p in sorted(paths) if p and not ignored(p, [], config)]
        if kept:
            refresh(batch.sparkSession.createDataFrame(kept, "path string"), n)

    return notices.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
