"""Restore sessions of a prefix however busy it is: ticks first, then one short row per tick.

Events of a prefix within one tick, which is not longer than the pause, belong to one session: first, last and count say all of
them. Spark adds these up on the map side, so a prefix that has most of the events sends one row per task and tick. `Sessions`
(transformWithState) joins the ticks of a prefix in order; ticks leave the aggregation when the watermark has closed them, so all
earlier ones are known by then. A session is emitted when a later tick begins beyond its pause, or by a timer when the watermark passes its end.

The result is that of a session window over the events. Needs `frontier.SETTINGS` (RocksDB).
"""

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions import fixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Sessions(StatefulProcessor):
    """The session of a prefix that is still open: first and last event in microseconds, and the number of events."""

    def __init__(self, pause_us: int):
        self.pause = pause_us

    def init(self, handle):
        self.handle = handle
        self.open = handle.getValueState("open", "first bigint, last bigint, n bigint")

    def _row(self, prefix, first, last, n):
        return Row(prefix=prefix, start_us=first, end_us=last + self.pause, fetches=n)

    def handleInputRows(self, key, rows, timerValues):
        now, done = self.open.get() if self.open.exists() else None, []
        for first, last, n in sorted((r.first, r.last, r.n) for r in rows):
            if now is not None and first < now[1] + self.pause:
                now = (now[0], max(now[1], last), now[2] + n)
                continue
            if now is not None:
                done.append(self._row(key[0], *now))
            now = (first, last, n)
        self.open.update(now)
        self.handle.registerTimer(-(-(now[1] + self.pause) // 1000))
        return iter(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = self.open.get() if self.open.exists() else None
        if now is None or now[1] + self.pause > 1000 * expiredTimerInfo.getExpiryTimeInMs():
            return iter([])
        self.open.clear()
        return iter([self._row(key[0], *now)])


def restore_sessions(events: DataFrame, delay="1 hour", pause_seconds=600, tick_seconds=300) -> DataFrame:
    """prefix, session_start, session_end (the pause included), fetches."""
    if tick_seconds > pause_seconds:
        raise ValueError("a tick must not be longer than the pause")
    at = F.unix_micros("time")
    ticks = (
        events.where(F.col("action") == fixed.ACTION_FETCH)
        .withWatermark("time", delay)
        .groupBy(F.window("time", f"{tick_seconds} seconds").alias("w"), "prefix")
        .agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
        .select("prefix", F.window_time("w").alias("time"), "first", "last", "n")
    )
    found = ticks.groupBy("prefix").transformWithState(
        Sessions(pause_seconds * 1_000_000), "prefix string, start_us bigint, end_us bigint, fetches bigint", "append", "eventTime"
    )
    return found.select("prefix", F.timestamp_micros("start_us").alias("session_start"), F.timestamp_micros("end_us").alias("session_end"), "fetches")
