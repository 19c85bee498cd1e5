"""Structured Streaming forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlake.sources.store import scratch


def _ran(stream: DataFrame, mode: str) -> DataFrame:
    """Run what is there to its end and read what the last batch (complete mode) or all batches (append) wrote."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "complete":

        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out")

        query = writer.foreachBatch(replace).start()
    else:
        query = writer.format("parquet").option("path", f"{path}/out").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def feed(events: DataFrame) -> DataFrame:
    """The activity log, appended as it comes."""
    return _ran(events, "append")


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per day and kind by tumbling windows."""
    windowed = events.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w"), "event").agg(F.count("*").alias("n"))
    return _ran(windowed.select(F.to_date("w.start").alias("day"), "event", "n"), "complete")


def once_per_actor(events: DataFrame, late: str = "3650 days") -> DataFrame:
    """The first event of each kind that an entity shows within the watermark."""
    return _ran(events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["entity_id", "event"]).select("entity_id", "event"), "append")


def once_per_day(events: DataFrame) -> DataFrame:
    """The first event of each kind that an entity shows on a day.  Repeats lie within a day of it, so a watermark of two
    days keeps the state bounded and drops each of them."""
    daily = events.withColumn("day", F.to_date("created_at")).withWatermark("created_at", "2 days")
    return _ran(daily.dropDuplicatesWithinWatermark(["entity_id", "event", "day"]).select("entity_id", "event", "day"), "append")


def due_class(scheduled_at: Column, now: Column, hours: int = 72) -> Column:
    """due, stale (too old: unscheduled, not sent) or future."""
    return F.when(scheduled_at > now, "future").when(scheduled_at < now - F.expr(f"interval '{hours}' hour"), "stale").otherwise("due")


def last_state(events: DataFrame, sets: list[str], clears: list[str]) -> DataFrame:
    """Per entity whether the last relevant event set or cleared the state (batch twin of the keyed state)."""
    relevant = events.where(F.col("event").isin(*sets, *clears))
    last = relevant.groupBy("entity_id").agg(F.max_by("event", F.struct("created_at", "event_id")).alias("event"))
    return last.select("entity_id", F.col("event").isin(*sets).alias("on"))
