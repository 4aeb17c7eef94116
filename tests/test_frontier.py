"""Live gap alarms against a slow version, for several cuts of the input into batches."""

import datetime
import random

import numpy as np
import pytest
from models import rows
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators import continuity
from tidemark.streaming import frontier, log_stream, uploads

START = datetime.datetime(2024, 3, 1)
TICK, GRACE = 600, 3600


def segment(pos, tli=1):
    return f"{tli:08X}{pos // 256:08X}{pos % 256:08X}"


def event(prefix, pos, second, state="complete", tli=1):
    return (START + datetime.timedelta(seconds=second), 1, "push-wal", "k", segment(pos, tli), prefix, state, 1.0)


EVENTS = "time timestamp, pid bigint, action string, key string, seg string, prefix string, state string, rate double"


def slow_alarms(events, mark):
    first = {}
    for t, _, action, _, seg, prefix, state, _ in events:
        if action == "push-wal" and state in ("complete", "skip"):
            s = (t - START).total_seconds()
            tick = (s // TICK + 1) * TICK
            key = (prefix, seg[:8], int(seg[8:16], 16) * 256 + int(seg[16:], 16))
            first[key] = min(tick, first.get(key, tick))
    out = []
    for (prefix, tli, pos), tick in first.items():
        line = {p: t for (x, y, p), t in first.items() if (x, y) == (prefix, tli)}
        due = min(t for p, t in line.items() if p >= pos) + GRACE
        below = [p for p, t in line.items() if p < pos and t <= due]
        if due <= mark and tick <= due and below and max(below) < pos - 1:
            out.append((prefix, tli, max(below) + 1, pos - 1, pos - 1 - max(below), START + datetime.timedelta(seconds=due)))
    return sorted(out, key=repr)


def streamed(spark, tmp_path, batches, per_batch=1, chunk=frontier.CHUNK):
    for n, batch in enumerate(batches):
        path = tmp_path / "in" / f"{n:03}"
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.parquet(str(path))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out, query = log_stream.run_available(frontier.gap_alarms(stream, chunk=chunk), "frontier", folder=str(tmp_path / "out"), wanted=frontier.SETTINGS)
    return rows(out)


def scattered(seed, n=700):
    """Mostly in order, with holes, disorder within the delay, repeats, two prefixes (one with most of the rows) and two timelines."""
    rng = random.Random(seed)
    events, pos = [], {("a", 1): 1000, ("a", 2): 50, ("b", 1): 7}
    for k in range(n):
        prefix, tli = rng.choice([("a", 1)] * 5 + [("a", 2), ("b", 1)])
        pos[prefix, tli] += rng.choice([1] * 9 + [2, 5, 1500])
        late = rng.randint(0, 1500)
        events.append(event(prefix, pos[prefix, tli], k * 60 + late, rng.choice(["complete", "skip"]), tli))
        if rng.random() < 0.2:
            events.append(event(prefix, pos[prefix, tli], k * 60 + late + rng.randint(1, 9000), "complete", tli))
        if rng.random() < 0.05:
            events.append(event(prefix, max(pos[prefix, tli] - rng.randint(1, 3), 0), k * 60 + rng.randint(0, 4000), "complete", tli))
    return events + [event("a", 3, 60, "begin")]


@pytest.mark.parametrize("seed,cuts,chunk", [(1, 1, 1024), (1, 7, 16), (2, 4, 1024)])
def test_alarms_do_not_depend_on_batches(spark, tmp_path, seed, cuts, chunk):
    # By event time, cut where they arrive: within the delay of an hour.
    events = sorted(scattered(seed), key=lambda e: e[0] + datetime.timedelta(seconds=random.Random(str(e)).randint(0, 1200)))
    size = -(-len(events) // cuts)
    batches = [events[k : k + size] for k in range(0, len(events), size)]
    last = max(e[0] for e in events if e[6] in ("complete", "skip"))
    mark = (last - START).total_seconds() - 3600
    got = streamed(spark, tmp_path, batches, chunk=chunk)
    assert got == slow_alarms(events, mark)
    assert len({g[:4] for g in got}) == len(got) > 20


def test_without_lateness_alarms_are_the_batch_gaps(spark, tmp_path):
    rng = random.Random(5)
    pos, events = 10, []
    for k in range(400):
        pos += rng.choice([1] * 6 + [3, 300])
        events += [event("a", pos, k * 30 + rng.randint(0, 900))] * rng.choice([1, 1, 3])
    closing = [event("z", 1, 400 * 30 + 900 + 3 * 3600), event("z", 2, 400 * 30 + 900 + 6 * 3600)]
    got = streamed(spark, tmp_path, [events, closing])
    archived = spark.createDataFrame([(0, e[4][:8], int(e[4][8:16], 16) * 256 + int(e[4][16:], 16)) for e in events], "prefix_id bigint, tli string, pos bigint").distinct()
    want = continuity.gaps(archived.withColumn("chunk", F.floor(F.col("pos") / 1024)))
    assert sorted(g[2:5] for g in got) == sorted((r.gap_from, r.gap_to, r.missing) for r in want.collect())


def test_a_query_goes_on_where_it_stopped(spark, tmp_path):
    first = [event("a", p, s) for p, s in ((1, 0), (2, 60), (5, 120))]
    later = [event("a", 9, 2 * 3600), event("a", 10, 8 * 3600)]
    assert streamed(spark, tmp_path, [first]) == []
    spark.createDataFrame(later, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / "900"))
    got = streamed(spark, tmp_path, [])
    assert [g[2:4] for g in got] == [(3, 4), (6, 8)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_runs_touch_and_merge():
    known = []
    for lo, hi in [(5, 6), (1, 2), (9, 9), (3, 3), (7, 8), (20, 30), (15, 40)]:
        frontier.add_run(known, lo, hi)
    assert known == [(1, 3), (5, 9), (15, 40)]
    frontier.add_run(known, 4, 4)
    assert known == [(1, 9), (15, 40)]


def test_runs_merge_as_they_are_added_one_by_one():
    rng = random.Random(3)
    for _ in range(200):
        runs = [(lo, lo + rng.randint(0, 9)) for lo in rng.choices(range(200), k=rng.randint(0, 30))]
        known = []
        for run in runs:
            frontier.add_run(known, *run)
        assert list(map(tuple, frontier.merged(np.array(runs, np.int64).reshape(-1, 2)).tolist())) == known


class Store:
    """Counts the calls of a processor to its state."""

    def __init__(self):
        self.values, self.calls, self.timers = {}, 0, set()

    def getValueState(self, name, _schema):
        return Cell(self, name)

    def getMapState(self, name, *_schemas):
        return Cell(self, name)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Cell:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _at(self, key=None):
        self.store.calls += 1
        return self.store.values.setdefault(self.name, {}), key

    def get(self):
        return self._at()[0][None]

    def exists(self):
        return None in self._at()[0]

    def update(self, value):
        self._at()[0][None] = value

    def clear(self):
        self._at()[0].clear()

    def getValue(self, key):
        return self._at()[0].get(key)

    def containsKey(self, key):
        return key in self._at()[0]

    def updateValue(self, key, value):
        self._at()[0][key] = value

    def removeKey(self, key):
        del self._at()[0][key]

    def keys(self):
        return list(self._at()[0])

    def iterator(self):
        return list(self._at()[0].items())


class Times:
    def __init__(self, mark, at=0):
        self.getCurrentWatermarkInMs, self.getExpiryTimeInMs = lambda: mark, lambda: at


def fire(processor, store, key, mark):
    """All timers up to the watermark, as Spark calls them."""
    out = []
    for at in sorted(t for t in store.timers if t <= mark):
        if at in store.timers:
            out += processor.handleExpiredTimer(key, Times(mark), Times(mark, at))
            store.timers.discard(at)
    return out


def test_a_tick_of_many_runs_takes_few_calls():
    """Two ticks of 500 runs each, in chunks of 50; each call crosses to the JVM and back."""
    store, processor = Store(), frontier.Frontier(GRACE * 1000)
    processor.init(store)
    rows_in = [Row(tick=tick, lo=[p], hi=[p], runs=[Row(lo=p, hi=p)]) for tick in (600_000, 1_200_000) for p in range(tick // 600_000, 2000, 4)]
    processor.handleInputRows(("a", "1"), iter(rows_in), None)
    got = fire(processor, store, ("a", "1"), 10**9)
    assert [(r.gap_from, r.gap_to) for r in got] == [(p, p + 1) for p in range(3, 1997, 4)]
    assert store.calls < 40 and not store.values["waiting"] and not store.timers


def test_an_upload_of_many_rows_takes_few_calls():
    store, processor = Store(), uploads.Outcomes(600_000_000)
    processor.init(store)
    seconds = 1_000_000
    rows_in = [Row(at=k * 1000 * seconds + d * seconds, state=s) for k in range(100) for s, d in (("begin", 0), ("skip", 9), ("complete", 9), ("skip", 700))]
    processor.handleInputRows(("a", 1, "k"), iter(rows_in), None)
    early = fire(processor, store, ("a", 1, "k"), 50 * 1000 * 1000)
    late = fire(processor, store, ("a", 1, "k"), 10**9)
    assert len(early) == 50 and [(r.begin_us, r.outcome, r.duration_us) for r in early + late] == [(k * 1000 * seconds, "complete", 9 * seconds) for k in range(100)]
    assert store.calls < 40 and not store.values["open"]
