"""Keyed streaming states (T5, T8, T9) and the reread do-not-contact list (T6); each has a batch twin.

Updates of every micro-batch are written under the batch's number, so a batch that is run again replaces itself; the
latest update of each key is its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from outlake.sources.store import scratch


def updates(stream: DataFrame, mode: str = "update", change: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """What each micro-batch gave, with its number in ``batch``."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = StructType(change(spark.createDataFrame([], stream.schema)).schema.fields).add("batch", "long")
    return spark.read.schema(schema).parquet(f"{path}/out") if query.lastProgress else spark.createDataFrame([], schema)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")


def last_of(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The last value of each key by ``order`` (longs or times), kept as keyed state over micro-batches."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = tuple(state.get) if state.exists else None
        for rows in batches:
            top = rows.sort_values(["a", "b"]).iloc[-1]
            if best is None or (top["a"], top["b"]) >= best[:2]:
                best = (int(top["a"]), int(top["b"]), top["value"])
        state.update(best)
        yield pd.DataFrame({"key": [keys[0]], "value": [best[2]]})

    rows = events.select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col(order[0]).cast("timestamp")).alias("a"), F.col(order[1]).cast("long").alias("b"), F.col(value).cast("string").alias("value"))
    out = rows.groupBy("key").applyInPandasWithState(run, "key long, value string", "a long, b long, value string", "update", GroupStateTimeout.NoTimeout)
    return latest(updates(out), ["key"]).select(F.col("key").alias(key), F.col("value").alias(value))


def opted_out(events: DataFrame, sets: list[str], clears: list[str]) -> DataFrame:
    """Per entity whether the last relevant event set or cleared the state."""
    relevant = events.where(F.col("event").isin(*sets, *clears))
    return last_of(relevant, "entity_id", ["created_at", "event_id"], "event").select("entity_id", F.col("event").isin(*sets).alias("on"))


def schedules(events: DataFrame, sets: str, edits: list[str]) -> DataFrame:
    """Per entity whether its schedule still holds: it was set, and no edit came later."""
    relevant = events.where(F.col("event").isin(sets, *edits))
    return last_of(relevant, "entity_id", ["created_at", "event_id"], "event").select("entity_id", (F.col("event") == sets).alias("scheduled"))


def reply_states(events: DataFrame, reply: str, none: str, bounce: str) -> DataFrame:
    """Reply state per entity over a stream of verdicts (T5): other events change nothing, a bounce is recorded once."""
    said = last_of(events.where(F.col("event").isin(reply, none)), "entity_id", ["created_at", "event_id"], "event")
    first = events.where(F.col("event") == bounce).groupBy("entity_id").agg(F.min("created_at").alias("bounced_at"))
    bounced = latest(updates(first), ["entity_id"])
    both = said.join(bounced, "entity_id", "full")
    return both.select("entity_id", F.coalesce(F.col("event") == reply, F.lit(False)).alias("has_response"), "bounced_at")


def unsuppressed(events: DataFrame, blocked: Callable[[], DataFrame]) -> DataFrame:
    """Events of entities that aren't on a list that is read again for every micro-batch; where it can't be read the
    batch fails and nothing passes (T6)."""
    return updates(events, "append", lambda batch: batch.join(blocked().select("entity_id").distinct(), "entity_id", "left_anti")).drop("batch")
