"""Interval families on a stream, as one state machine per (subject, object).

An event opens an interval, closes all open ones of its key, or does both:
states and contents close and open, memberships open on ``add`` and close on ``remove``, comments
open on ``created`` and ``edited`` and close on ``edited`` and ``deleted``.

Events may arrive out of order by up to the watermark's delay.  They wait in list state, and a timer at the earliest of
them lets all through in order that the watermark has passed; later arrivals are dropped by nobody silently
(``ledger.ingest`` puts them aside).  The open intervals of the key are the other list.  Of rows with one time and id the last
arrival counts.  Each trigger touches the state of a key a fixed number of times, not once per event.  Keys are
(subject, object), so a subject with very many labels or reviewers is many small states.
Closed intervals are emitted, open ones stay in the state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Keys with nulls do not come back from the state as they were: the object is a text, empty for none.
CLOSED = "subject_id bigint, object_key string, value string, start_id bigint, end_id bigint, start_ts bigint, end_ts bigint"
_NEVER = -(1 << 63)  # stands for no time
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Families(StatefulProcessor):
    """State of one (subject, object): waiting events and open intervals."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting_events", "ts bigint, id bigint, opens boolean, closes boolean, value string")
        self.open = handle.getListState("open_intervals", "ts bigint, id bigint, value string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = [(r.micros, r.event_id, r.opens, r.closes, r.value) for r in rows]
        if events:
            self.waiting.appendList(events)
            self.handle.registerTimer(min(e[0] for e in events) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = {(e[0], e[1]): tuple(e[2:]) for e in self.waiting.get()}
        ready = sorted(k for k in waiting if k[0] < due)
        if not ready:  # an earlier timer of this watermark took them
            return
        shown: dict = {}
        known = False  # whether the intervals of earlier timers are among the shown ones
        out = []
        for at in ready:
            opens, closes, value = waiting.pop(at)
            if closes:
                if not known:
                    shown = {(e[0], e[1]): e[2] for e in self.open.get()} | shown
                    known = True
                for start, own in sorted(shown.items()):
                    out.append(Row(subject_id=key[0], object_key=key[1], value=own, start_id=start[1], end_id=at[1], start_ts=start[0], end_ts=at[0]))
                shown = {}
            if opens:
                shown[at] = value
        left = [(*k, v) for k, v in shown.items()]
        if known:
            self.open.clear()
        if left:
            self.open.appendList(left)
        self.waiting.clear()
        if waiting:
            self.waiting.appendList([(*k, *v) for k, v in waiting.items()])
            self.handle.registerTimer(min(waiting)[0] // 1000 + 1)
        yield from out

    def close(self) -> None:
        pass


def keyed(events: DataFrame, opens: Column, closes: Column, value: Column, object_id: Column | None = None) -> DataFrame:
    """Events (subject_id, event_id, ts) in the shape the state machine reads; others than opening and closing ones are left out."""
    rows = events.filter(opens | closes)
    object_key = F.lit("") if object_id is None else F.coalesce(object_id.cast("bigint").cast("string"), F.lit(""))
    return rows.select("subject_id", object_key.alias("object_key"),
                       F.col("event_id").cast("bigint").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"),
                       F.coalesce(opens, F.lit(False)).alias("opens"), F.coalesce(closes, F.lit(False)).alias("closes"), value.cast("string").alias("value"))


def use_state_store(spark: SparkSession) -> None:
    """List state and timers need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def closed_intervals(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Closed intervals of ``keyed`` rows whose end the watermark has passed."""
    use_state_store(rows.sparkSession)
    timed = rows.withWatermark("ts", delay).withColumn("micros", F.coalesce(F.unix_micros("ts"), F.lit(_NEVER)))
    found = timed.groupBy("subject_id", "object_key").transformWithState(Families(), CLOSED, "Append", "EventTime")
    times = [F.timestamp_micros(F.nullif(F.col(c), F.lit(_NEVER))).alias(c) for c in ("start_ts", "end_ts")]
    return found.select("subject_id", F.when(F.col("object_key") != "", F.col("object_key").cast("bigint")).alias("object_id"), "value", "start_id", "end_id", *times)
