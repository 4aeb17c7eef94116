"""Upload outcomes and committed backups out of streams."""

import datetime
import random

import pytest
from models import rows

from tidemark.sinks import commits
from tidemark.streaming import frontier, log_stream, uploads

START = datetime.datetime(2024, 3, 1)
EVENTS = "time timestamp, pid bigint, action string, key string, seg string, prefix string, state string, rate double"


def event(second, state, key="k", pid=1, prefix="p"):
    return (START + datetime.timedelta(seconds=second), pid, "push-wal", key, "s", prefix, state, None)


def slow_outcomes(events, mark):
    out, keys = [], {}
    for t, pid, action, key, _, prefix, state, _ in events:
        if action == "push-wal" and state in ("begin", "complete", "skip"):
            keys.setdefault((prefix, pid, key), set()).add((t, state))
    for k, found in keys.items():
        begins = sorted({t for t, s in found if s == "begin"})
        for n, b in enumerate(begins):
            until = begins[n + 1] if n + 1 < len(begins) else datetime.datetime.max
            ends = sorted((t, s) for t, s in found if s != "begin" and b <= t < until and t <= b + datetime.timedelta(minutes=10))
            if b + datetime.timedelta(minutes=10) <= mark:
                first = ends[0] if ends else (None, None)
                out.append((*k, b, first[1], ends and int((first[0] - b) / datetime.timedelta(microseconds=1)) or (0 if ends else None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cuts", [1, 6])
def test_each_begin_has_one_outcome(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    events = []
    for k in range(300):
        at, key = k * 40 + rng.randint(0, 30), f"k{rng.randint(0, 30)}"
        events += [event(at, "begin", key)] * rng.choice([1, 1, 2])
        if rng.random() < 0.3:
            events.append(event(at + rng.randint(1, 200), "begin", key))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            events.append(event(at + rng.choice([0, 5, 100, 600, 601, 900]), rng.choice(["complete", "skip"]), key))
    events.append(event(300 * 40 + 5 * 3600, "skip", "last"))
    events.sort(key=lambda e: e[0] + datetime.timedelta(seconds=random.Random(str(e)).randint(0, 1000)))
    size = -(-len(events) // cuts)
    for n in range(0, len(events), size):
        spark.createDataFrame(events[n : n + size], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:05}"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out, _ = log_stream.run_available(uploads.outcomes(stream), "outcomes", folder=str(tmp_path / "out"), wanted=frontier.SETTINGS)
    want = slow_outcomes(events, max(e[0] for e in events) - datetime.timedelta(hours=1))
    assert rows(out) == want and len({w[:4] for w in want}) == len(want) > 250


ROWS = "prefix_id bigint, name string, path string, content string, body string"


def member(name, path):
    return (1, name, path, f"content of {path}", None)


def stop(name):
    return (1, name, None, None, '{"n": 1}')


def arrivals(spark, tmp_path, batches):
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, ROWS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:03}"))
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def seen(spark, root):
    sentinels, members = commits.committed(spark, root)
    return sorted(r.name for r in sentinels.collect()), sorted((r.name, r.path) for r in members.collect())


def test_a_batch_that_stops_before_the_sentinel_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "root")
    batches = [[member("a", "1"), member("b", "1"), stop("b")], [member("a", "2"), stop("a"), member("c", "1")]]
    stream = arrivals(spark, tmp_path, batches)

    def stops_early(df, batch, at):
        if batch:
            commits.write_members(df, batch, at)
            raise RuntimeError("lost")
        commits.write_batch(df, batch, at)

    with pytest.raises(Exception, match="lost"):
        commits.commit_available(stream, root, stops_early)
    assert seen(spark, root) == (["b"], [("b", "1")])
    # The same batch runs again and leaves every row once.
    commits.commit_available(arrivals(spark, tmp_path, []), root)
    assert seen(spark, root) == (["a", "b"], [("a", "1"), ("a", "2"), ("b", "1")])


def test_a_batch_run_twice_leaves_the_same_rows(spark, tmp_path):
    root = str(tmp_path / "root")
    batch = spark.createDataFrame([member("a", "1"), member("a", "2"), stop("a"), stop("a")], ROWS)
    commits.write_batch(batch, 0, root)
    once = seen(spark, root)
    commits.write_batch(batch.repartition(3), 0, root)
    assert seen(spark, root) == once == (["a"], [("a", "1"), ("a", "2")])


@pytest.mark.parametrize("cuts", [1, 5])
def test_sessions_of_a_busy_prefix(spark, tmp_path, cuts):
    from tidemark.streaming import sessions

    rng = random.Random(cuts + 10)
    events, at = [], 0
    for k in range(1500):
        at += rng.choice([1, 5, 30] * 8 + [599, 600, 601, 1500, 4000])
        events.append((START + datetime.timedelta(seconds=at, microseconds=k), 1, "wal-fetch", "k", "s", "busy" if k % 10 else "idle", "begin", None))
    events.append((START + datetime.timedelta(seconds=at + 9000), 1, "wal-fetch", "k", "s", "last", "begin", None))
    mark = events[-1][0] - datetime.timedelta(hours=1)
    want = []
    for prefix in ("busy", "idle", "last"):
        times = [e[0] for e in events if e[5] == prefix]
        run = [times[0]]
        for t in [*times[1:], datetime.datetime.max]:
            if t - run[-1] >= datetime.timedelta(minutes=10):
                if run[-1] + datetime.timedelta(minutes=10) <= mark:
                    want.append((prefix, run[0], run[-1] + datetime.timedelta(minutes=10), len(run)))
                run = []
            run.append(t)
    events.sort(key=lambda e: e[0] + datetime.timedelta(seconds=random.Random(str(e)).randint(0, 1500)))
    size = -(-len(events) // cuts)
    for n in range(0, len(events), size):
        spark.createDataFrame(events[n : n + size], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:05}"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out, _ = log_stream.run_available(sessions.restore_sessions(stream), "s", folder=str(tmp_path / "out"), wanted=frontier.SETTINGS)
    assert rows(out) == sorted(want, key=repr) and len(want) > 20
