"""Live gap alarms: up to where a timeline is archived, kept as state, and what is missing below.

Two stateful operators in a row.

1. Arrivals are gathered per (tick, prefix, timeline, chunk of positions) by a windowed aggregation. Spark adds up on the map side first,
   repeats of a segment vanish in the set, and a busy prefix is spread over its chunks. A closed tick leaves as unbroken runs.
2. `Frontier` (transformWithState) keeps per (prefix, timeline) the highest position that was due, up to which everything is settled, and the runs
   that are not due yet. It sees runs, not segments, and calls its store by ticks.

What counts is event time alone, so the alarms are the same however the input is cut into batches and in whatever order it comes
within the delay. A run is due `grace` after the end of its tick, and then the frontier moves up to its end, if that is higher. Known at that moment
are all positions whose first tick has ended; every gap between known positions that the frontier passes is an alarm.
Positions at or below the frontier raise nothing any more: a gap alarms once, and repeats never do. Below a timeline's lowest known position nothing
is missing. Without arrivals later than the grace, the alarms are the gaps of the batch operator.

The state store must be RocksDB; `SETTINGS` holds what the query needs, for `log_stream.run_available`.
"""

import sys
from bisect import bisect_left

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions import fixed, names

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
CHUNK = 1024
HELD = 1_000_000
ALARM = "prefix string, tli string, gap_from bigint, gap_to bigint, due timestamp"


def arrivals(events: DataFrame) -> DataFrame:
    """prefix, tli, pos, time of archived segments; names without a place in the sequence are left out."""
    s = names.parse_segment("seg")
    found = events.where((F.col("action") == fixed.ACTION_PUSH) & F.col("state").isin("complete", "skip") & s.isNotNull())
    return found.select("prefix", s["tli"].alias("tli"), names.position(s["log"], s["seg"]).alias("pos"), "time").where("pos is not null")


def arrived_runs(arrived: DataFrame, delay: str, tick: str, chunk=CHUNK) -> DataFrame:
    """prefix, tli, time (just before the end of the tick), runs: sorted unbroken runs of the positions that came in the tick, per chunk."""
    in_tick = (
        arrived.withWatermark("time", delay)
        .groupBy(F.window("time", tick).alias("w"), "prefix", "tli", F.floor(F.col("pos") / chunk).alias("chunk"))
        .agg(F.sort_array(F.collect_set("pos")).alias("p"))
    )
    p, last = F.col("p"), F.size("p") - 1
    first_of = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) < x - 1))
    last_of = F.filter(p, lambda x, i: (i == last) | (F.get(p, i + 1) > x + 1))
    runs = F.zip_with(first_of, last_of, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    return in_tick.select("prefix", "tli", F.window_time("w").alias("time"), F.unix_millis(F.col("w.end")).alias("tick"), runs.alias("runs"))


def add_run(known: list, lo: int, hi: int) -> None:
    """Add a run to a sorted list of runs that neither touch nor overlap."""
    at = bisect_left(known, (lo,))
    if at and known[at - 1][1] >= lo - 1:
        at -= 1
        lo, hi = known[at][0], max(hi, known[at][1])
    end = at
    while end < len(known) and known[end][0] <= hi + 1:
        hi = max(hi, known[end][1])
        end += 1
    known[at:end] = [(lo, hi)]


def merged(runs: np.ndarray) -> np.ndarray:
    """Runs (rows of lo, hi) in order, those that touch or overlap joined."""
    if not len(runs):
        return runs
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    top = np.maximum.accumulate(runs[:, 1])
    first = np.r_[True, runs[1:, 0] > top[:-1] + 1]
    return np.stack([runs[first, 0], top[np.r_[first[1:], True]]], 1)


class Frontier(StatefulProcessor):
    """Highest position that was due, and the runs that wait, of one timeline of one prefix.

    Runs wait as one value per tick (and per HELD runs of it), and only the earliest tick has a timer, so calls to the store go by ticks. Ticks
    are read one by one as they come due: what lies at or below the frontier is not kept.
    """

    def __init__(self, grace_ms: int):
        self.grace = grace_ms

    def init(self, handle):
        self.handle = handle
        self.frontier = handle.getValueState("frontier", "pos bigint, timer bigint")
        self.waiting = handle.getMapState("waiting", "tick bigint, lo bigint", "runs binary")

    def _keep(self, found: dict):
        for tick, parts in found.items():
            runs = np.concatenate(parts)
            at = (tick, int(runs[:, 0].min()))
            known = self.waiting.getValue(at)
            self.waiting.updateValue(at, ((known[0] if known else b"") + runs.tobytes(),))

    def _runs(self, at) -> np.ndarray:
        return np.frombuffer(self.waiting.getValue(at)[0], np.int64).reshape(-1, 2)

    def handleInputRows(self, key, rows, timerValues):
        reached, timer = self.frontier.get() if self.frontier.exists() else (None, None)
        found, held, earliest = {}, 0, None
        for row in rows:
            runs = np.array([row.lo, row.hi], np.int64).T
            if reached is not None:
                runs = runs[runs[:, 1] > reached]
            if len(runs):
                found.setdefault(row.tick, []).append(runs)
                held += len(runs)
                earliest = row.tick if earliest is None else min(earliest, row.tick)
            if held >= HELD:
                self._keep(found)
                found, held = {}, 0
        self._keep(found)
        if earliest is not None and (timer is None or earliest + self.grace < timer):
            self._set(reached, timer, earliest + self.grace)
        return iter([])

    def _set(self, reached, timer, wanted):
        if timer is not None:
            self.handle.deleteTimer(timer)
        if wanted is not None:
            self.handle.registerTimer(wanted)
        self.frontier.update((reached, wanted))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """All ticks that are due by the watermark, oldest first."""
        mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        reached, _ = self.frontier.get()
        places = {}
        for tick, lo in sorted(self.waiting.keys()):
            places.setdefault(tick, []).append((tick, lo))
        ticks, known, seen, tops, alarms = list(places), np.empty((0, 2), np.int64), 0, {}, []
        due = [t for t in ticks if t + self.grace <= mark]
        for tick in due:
            fresh = [known]
            while seen < len(ticks) and ticks[seen] <= tick + self.grace:
                runs = np.concatenate([self._runs(at) for at in places[ticks[seen]]])
                tops[ticks[seen]] = int(runs[:, 1].max())
                fresh.append(runs if reached is None else runs[runs[:, 1] > reached])
                seen += 1
            known, top = merged(np.concatenate(fresh)), tops[tick]
            if reached is None:
                reached = int(known[0, 0])
            if top <= reached:
                continue
            passed = known[known[:, 0] <= top]
            below = np.maximum(np.r_[reached, passed[:-1, 1]], reached)
            gap = passed[:, 0] > below + 1
            for lo, hi in zip((below[gap] + 1).tolist(), (passed[gap, 0] - 1).tolist(), strict=True):
                alarms.append(Row(prefix=key[0], tli=key[1], gap_from=lo, gap_to=hi, due_ms=tick + self.grace))
            reached = top
            known = known[known[:, 1] > reached]
        for tick in due:
            for at in places[tick]:
                self.waiting.removeKey(at)
        later = ticks[len(due) :]
        wanted = later[0] + self.grace if later else None
        if wanted is not None:
            self.handle.registerTimer(wanted)
        self.frontier.update((reached, wanted))
        return iter(alarms)


def gap_alarms(events: DataFrame, delay="1 hour", tick="10 minutes", grace="1 hour", chunk=CHUNK) -> DataFrame:
    """prefix, tli, gap_from, gap_to (positions), missing (how many), due (when the alarm was raised, in event time)."""
    grace_ms = int(events.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp_millis(0) + interval {grace})")).first()[0])
    runs = arrived_runs(arrivals(events), delay, tick, chunk).select("prefix", "tli", "time", "tick", F.col("runs.lo").alias("lo"), F.col("runs.hi").alias("hi"))
    found = runs.groupBy("prefix", "tli").transformWithState(
        Frontier(grace_ms), "prefix string, tli string, gap_from bigint, gap_to bigint, due_ms bigint", "append", "eventTime"
    )
    return found.select("prefix", "tli", "gap_from", "gap_to", (F.col("gap_to") - F.col("gap_from") + 1).alias("missing"), F.timestamp_millis("due_ms").alias("due"))
