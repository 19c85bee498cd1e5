"""Keyed states in event time (T3, T4): list states in order of time, event-time timers, and their batch twins.

Both run on ``transformWithState``, which needs the RocksDB state store.  Events may come in any order within the
watermark's delay; what is later is dropped, as by every stream.  One key's events of one micro-batch are held by a task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

from outlake.functions import schedule
from outlake.streaming.keyed import latest, updates

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timer_states(spark: SparkSession) -> Iterator[None]:
    """Timers and list states live in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


class Bursts(StatefulProcessor):
    """Times of an entity's events, in order, back to one window before the watermark.

    An event that comes late changes the counts of those after it that are already out: they are given again.
    """

    def __init__(self, span: int):
        self.span = span  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at long, event_id long")

    def _keep(self, times: list[tuple[int, int]], watermark: int) -> int:
        """Store what later events can still see; how many that are."""
        kept = times[bisect_right(times, (watermark * 1000 - self.span, 2**63)) :]
        if kept:
            self.times.put(kept)
        else:
            self.times.clear()
        return len(kept)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = sorted((r.at, r.event_id) for r in rows)
        every = sorted([*self.times.get(), *new])
        times, fresh = [at for at, _ in every], [at for at, _ in new]
        held = self._keep(every, timerValues.getCurrentWatermarkInMs())
        self.handle.registerTimer((times[-1] + self.span) // 1000 + 1)
        # an event is given if one that has just come lies in its window, itself included
        for at, event_id in every[bisect_left(times, fresh[0]) :]:
            if bisect_right(fresh, at - self.span) < bisect_right(fresh, at):
                first = bisect_right(times, at - self.span)
                wait = round(self.span / 1e6 - (at - times[first]) / 1e6 + 0.05, 2)
                yield Row(event_id=event_id, in_window=bisect_right(times, at) - first, retry_after=wait, held=held)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        times = sorted(self.times.get())
        self._keep(times, timerValues.getCurrentWatermarkInMs())
        return iter(())


def burst_updates(events: DataFrame, seconds: int, late: str) -> DataFrame:
    """Each count as it was given, with the micro-batch's number and how many times the state then held."""
    keyed = events.withWatermark("created_at", late).select("event_id", "entity_id", "created_at", F.unix_micros("created_at").alias("at")).groupBy("entity_id")
    out = keyed.transformWithState(Bursts(seconds * 1_000_000), "event_id long, in_window long, retry_after double, held long", "Update", "EventTime")
    with timer_states(events.sparkSession):
        return updates(out)


def bursts(events: DataFrame, seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """For each event how many of its entity fall in the ``seconds`` before it, itself included, and how long until the
    oldest of them leaves the window: the last count given for it.  ``windows.burst`` is the batch twin."""
    return latest(burst_updates(events, seconds, late), ["event_id"]).drop("held")


class Sweep(StatefulProcessor):
    """An entity's queued mails and the edits that cancel them, until the moment comes at which each fires.

    A timer is set for that moment.  When the watermark has passed it, everything before it has come, so it is known
    whether something replaced or cancelled the mail; what is left is due, or stale if the window stayed shut too long.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "at long, event_id long, fires long, stale boolean")

    def _read(self) -> list[tuple]:
        return sorted(self.events.get(), key=lambda e: e[:2])

    def _store(self, events: list[tuple], watermark: int) -> None:
        # what lies before the watermark matters only to a mail before it that still waits
        waiting = next((k for k, e in enumerate(events) if e[2] is not None), len(events))
        kept = [e for k, e in enumerate(events) if k >= waiting or e[0] > watermark * 1000]
        if kept:
            self.events.put(kept)
        else:
            self.events.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.at, r.event_id, r.fires, r.stale) for r in rows]
        self._store(sorted([*self._read(), *new], key=lambda e: e[:2]), timerValues.getCurrentWatermarkInMs())
        for moment in {-(-fires // 1000) for _, _, fires, _ in new if fires is not None}:
            self.handle.registerTimer(moment)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        moment = expiredTimerInfo.getExpiryTimeInMs() * 1000
        events, left, out = self._read(), [], []
        for k, (at, event_id, fires, stale) in enumerate(events):
            if fires is not None and fires <= moment:
                if k + 1 == len(events) or events[k + 1][0] > fires:
                    out.append(Row(event_id=event_id, fired_at=fires, outcome="stale" if stale else "due"))
                left.append((at, event_id, None, None))  # it still replaces an earlier mail
            else:
                left.append((at, event_id, fires, stale))
        self._store(left, timerValues.getCurrentWatermarkInMs())
        return iter(out)


def queue_events(events: DataFrame, windows: DataFrame, sets: str, edits: list[str], scheduled_at: Column, hours: int = 72) -> DataFrame:
    """``event_id, entity_id, created_at, at, fires, stale`` of events that queue a mail or cancel what is queued.

    ``windows`` has entity_id and window (normal, see ``schedule``).  A mail fires at the first opening from its moment
    on; if there is none within ``hours``, or the window is off, it is given up when those are over.
    """
    rows = events.where(F.col("event").isin(sets, *edits)).join(windows, "entity_id", "left")
    moment = F.when(F.col("event") == sets, scheduled_at)
    opens, ends = schedule.next_opening(F.col("window"), moment), moment + F.make_dt_interval(hours=F.lit(hours))
    stale = F.coalesce(opens > ends, F.lit(True))
    fires = F.when(moment.isNotNull(), F.unix_micros(F.when(stale, ends).otherwise(opens)))
    return rows.select("event_id", "entity_id", "created_at", F.unix_micros("created_at").alias("at"), fires.alias("fires"), F.when(moment.isNotNull(), stale).alias("stale"))


def due_sweep(queued: DataFrame, late: str) -> DataFrame:
    """``event_id, outcome, fired_at`` of what fired up to the watermark; ``queued`` is a stream of ``queue_events``."""
    keyed = queued.withWatermark("created_at", late).groupBy("entity_id")
    out = keyed.transformWithState(Sweep(), "event_id long, fired_at long, outcome string", "Append", "EventTime")
    with timer_states(queued.sparkSession):
        return updates(out, "append").select("event_id", "outcome", F.timestamp_micros("fired_at").alias("fired_at"))


def due_sweep_twin(queued: DataFrame, late: str) -> DataFrame:
    """The same over all events at once: what fires before the latest event less the delay and isn't replaced before."""
    following = F.lead("at").over(W.partitionBy("entity_id").orderBy("at", "event_id"))
    last = queued.agg(F.unix_micros(F.max("created_at") - F.expr(f"interval {late}")).alias("end"))
    rows = queued.withColumn("next", following).crossJoin(F.broadcast(last))
    fired = rows.where("fires is not null and fires < end and (next is null or next > fires)")
    return fired.select("event_id", F.when(F.col("stale"), "stale").otherwise("due").alias("outcome"), F.timestamp_micros("fires").alias("fired_at"))
