"""Structured Streaming: a watcher over new properties, an upgrade-only cache and a ledger, each by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartolex.operators.landmarks import upgrade_cache


def watch(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = "60 seconds") -> StreamingQuery:
    """Runs ``handle`` on each micro-batch of rows that have no geo_source yet; unprocessed rows come again after a failure."""
    writer = rows.where("geo_source is null").writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def watch_cache(offers: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the best landmark of each property under ``path``: every batch is merged with what is there, by version folders."""
    spark = offers.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.select("property_id", "landmark", "tier", "seq")
        if number:
            new = new.unionByName(latest(spark, path, number - 1).select("property_id", "landmark", "tier", "seq"))
        upgrade_cache(new).drop("offers").write.mode("overwrite").parquet(f"{path}/v{number}")

    writer = offers.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


def latest(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v{number}")


def dedup_ledger(events: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each event once, with state for as long as events may be late."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))
