"""One outcome per upload: each begin with the end that answers it, kept as state per (prefix, pid, key).

An upload begins, and ends by `complete` or `skip`. An end answers the last begin at or before it, and only the first end counts; it
must come before the next begin and within the bound. So a begin has at most one end and an end at most one begin, also
when rows repeat or begins are logged again. What counts is event time: a begin is decided once the
watermark has passed its bound, and the result is the same however the input is cut into batches.

State holds the begins that are not decided and the ends that may still answer one; both leave by a timer for the earliest. Needs `frontier.SETTINGS` (RocksDB).
"""

import sys
from bisect import bisect_left

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions import fixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Outcomes(StatefulProcessor):
    """Open begins and ends of one upload key, in microseconds: one value, and one timer for the earliest of them."""

    def __init__(self, within_us: int):
        self.within = within_us

    def init(self, handle):
        self.handle = handle
        self.open = handle.getValueState("open", "begins array<bigint>, ends_at array<bigint>, ends array<string>, timer bigint")

    def _state(self):
        begins, ends_at, ends, timer = self.open.get() if self.open.exists() else ([], [], [], None)
        return set(begins), dict(zip(ends_at, ends, strict=True)), timer

    def _set(self, begins, ends, timer):
        """Keep what is open; its timer is the first whole millisecond at which the earliest of it plus the bound has passed."""
        if not begins and not ends:
            self.open.clear()
            return
        wanted = -(-(min([*begins, *ends]) + self.within) // 1000)
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        self.open.update((sorted(begins), list(ends), list(ends.values()), wanted))

    def handleInputRows(self, key, rows, timerValues):
        begins, ends, timer = self._state()
        for row in rows:
            if row.state == "begin":
                begins.add(row.at)
            else:
                ends[row.at] = min(row.state, ends.get(row.at, row.state))
        self._set(begins, ends, timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = 1000 * max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        begins, ends, _ = self._state()
        ordered, times, out = sorted(begins), sorted(ends), []
        for k, at in enumerate(ordered):
            if at + self.within > mark:
                break
            until = ordered[k + 1] if k + 1 < len(ordered) else None
            # The first end from the begin on; if that is none of its own, no later one is.
            n = bisect_left(times, at)
            end = times[n] if n < len(times) and times[n] <= at + self.within and (until is None or times[n] < until) else None
            out.append(Row(prefix=key[0], pid=key[1], key=key[2], begin_us=at, outcome=None if end is None else ends[end], duration_us=None if end is None else end - at))
            begins.remove(at)
        # No begin from before the watermark can come any more.
        self._set(begins, {at: state for at, state in ends.items() if at + self.within > mark}, None)
        return iter(out)


def outcomes(events: DataFrame, delay="1 hour", within_seconds=600) -> DataFrame:
    """prefix, pid, key, begin_time, outcome (complete, skip or null), duration_us: one row per begin."""
    push = events.where((F.col("action") == fixed.ACTION_PUSH) & F.col("state").isin(*fixed.STATES)).withWatermark("time", delay)
    rows = push.select("prefix", "pid", "key", "state", F.unix_micros("time").alias("at"), "time")
    found = rows.groupBy("prefix", "pid", "key").transformWithState(
        Outcomes(within_seconds * 1_000_000), "prefix string, pid bigint, key string, begin_us bigint, outcome string, duration_us bigint", "append", "eventTime"
    )
    return found.select("prefix", "pid", "key", F.timestamp_micros("begin_us").alias("begin_time"), "outcome", "duration_us")
