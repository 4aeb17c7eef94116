import random

import models
import pytest
from models import rows
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import names
from tidemark.operators import continuity
from tidemark.streaming import log_stream

CHUNK = 16


def positions(spark, seed, n=150, span=400):
    rng = random.Random(seed)
    data = {(1, "00000001", rng.randrange(span)) for _ in range(n)} | {(1, "00000002", rng.randrange(50)) for _ in range(20)}
    data |= {(2, "00000001", p) for p in range(30, 100)}
    df = spark.createDataFrame(sorted(data), "prefix_id bigint, tli string, pos bigint")
    df = df.withColumn("chunk", F.floor(F.col("pos") / CHUNK).cast("bigint")).repartition("prefix_id", "tli", "chunk")
    by_line = {}
    for p, t, x in data:
        by_line.setdefault((p, t), []).append(x)
    return by_line, df


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_islands_and_gaps(spark, seed):
    by_line, df = positions(spark, seed, n=150 if seed < 3 else 380)
    want_runs = sorted((p, t, a, z, z - a + 1) for (p, t), xs in by_line.items() for a, z in models.runs(xs))
    got = continuity.islands(df, CHUNK).select("prefix_id", "tli", "from_pos", "to_pos", "segments")
    assert sorted(map(tuple, got.collect())) == want_runs
    want_gaps = []
    for (p, t), xs in by_line.items():
        r = models.runs(xs)
        want_gaps += [(p, t, a[1] + 1, b[0] - 1, b[0] - a[1] - 1) for a, b in zip(r, r[1:])]
    found = continuity.gaps(df)
    assert sorted(map(tuple, found.collect())) == sorted(want_gaps)
    missing = {(p, t, x) for p, t, a, z, _ in want_gaps for x in range(a, z + 1)}
    assert {tuple(r)[:3] for r in continuity.gap_segments(found, step=3).collect()} == missing


def test_lone_ff_is_tolerated(spark):
    df = spark.createDataFrame(
        [(1, "t", 254, 0), (1, "t", 256, 0), (1, "t", 300, 0), (1, "t", 302, 0)], "prefix_id bigint, tli string, pos bigint, chunk bigint"
    )
    assert continuity.gaps(df).count() == 3
    assert sorted(r.gap_from for r in continuity.gaps(df, skip_ff=True).collect()) == [257, 301]


@pytest.mark.parametrize("seed", [1, 2])
def test_cover(spark, seed):
    by_line, df = positions(spark, seed, n=350)
    rng = random.Random(seed)
    ranges = []
    for i in range(60):
        line = rng.choice(list(by_line))
        a = rng.randrange(400)
        ranges.append((*line, f"b{i}", a, a + rng.choice([0, 1, 2, 5, 40])))
    ranges.append((2, "00000001", "whole", 30, 99))
    ranges.append((2, "00000001", "beyond", 30, 100))
    r = spark.createDataFrame(ranges, "prefix_id bigint, tli string, name string, start_pos bigint, stop_pos bigint")
    got = {x.name: x.covered for x in continuity.backup_cover(r, df, CHUNK).collect()}
    assert got == {n: set(range(a, z + 1)) <= set(by_line[(p, t)]) for p, t, n, a, z in ranges}


def test_restarts(spark):
    data = [("00000001", 1), ("00000001", 2), ("00000002", 3), ("00000002", 9), ("00000002", 10), ("00000001", 10)]
    df = spark.createDataFrame(
        [(1, "segment", t, f"{p // 256:08X}{p % 256:08X}") for t, p in data], "prefix_id bigint, thing string, tli string, sn string"
    )
    got = sorted((r.pos, r.tli, r.kind) for r in continuity.restarts(df, 4).collect())
    assert got == [(1, "00000001", "first"), (3, "00000002", "timeline"), (9, "00000002", "gap"), (10, "00000001", "timeline"), (10, "00000002", "timeline")]


def test_segments_after(spark):
    df = spark.createDataFrame([("00000001", "00000000", "000000FE"), ("00000001", "FFFFFFFF", "000000FE")], "tli string, log string, seg string")
    got = [r.segment for r in continuity.segments_after(df, 2).orderBy("pos").collect()]
    assert got == ["0000000100000000000000FF", "000000010000000100000000", "00000001FFFFFFFF000000FF"]
    assert continuity.segments_after(df, 0).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_restore_points(spark, seed):
    rng = random.Random(seed)
    backups = [(rng.choice([1, 1, 1, 2]), f"base{i}", f"k{i:03}", rng.randrange(0, 100_000, 100)) for i in range(80)]
    targets = [(i, rng.choice([1, 2, 3]), rng.randrange(0, 110_000, 50)) for i in range(120)]
    b = spark.createDataFrame(backups, "prefix_id bigint, name string, key string, s bigint").withColumn("last_modified", F.timestamp_seconds("s"))
    t = spark.createDataFrame(targets, "request_id bigint, prefix_id bigint, s bigint").withColumn("target", F.timestamp_seconds("s"))
    got = {r.request_id: r.name for r in continuity.restore_points(b, t).collect()}
    want = {}
    for i, p, at in targets:
        usable = [(s, k, n) for bp, n, k, s in backups if bp == p and s <= at]
        want[i] = max(usable)[2] if usable else None
    assert got == want


def test_cadence(spark):
    df = spark.createDataFrame(
        [(1, "a", "0000000000000001", 0), (1, "b", "0000000000000011", 60), (1, "c", "0000000100000000", 90)], "prefix_id bigint, name string, sn string, s bigint"
    ).withColumn("last_modified", F.timestamp_seconds("s"))
    got = sorted((r.name, r.previous_name, r.segments_between, r.seconds_between) for r in continuity.backup_cadence(df, 8).collect())
    assert got == [("a", None, None, None), ("b", "a", 16, 60), ("c", "b", 239, 30)]


def test_positions(spark):
    df = spark.createDataFrame([("0000000000000100",), ("00000001000000FF",)], "sn string")
    assert [r[0] for r in df.select(names.position_of_sn("sn")).collect()] == [None, 511]
    assert rows(df.where("sn = '00000001000000FF'").select(names.sn_of_position(names.position_of_sn("sn")))) == [("00000001000000FF",)]


def test_wild_ranges_stay_small(spark):
    """A gap of 2^32 segments is one row, and a backup with a wild stop costs one row, not one per chunk."""
    df = spark.createDataFrame([(1, "t", 0, 0), (1, "t", 2**32 + 1, 2**32 // CHUNK)], "prefix_id bigint, tli string, pos bigint, chunk bigint")
    assert [r.missing for r in continuity.gaps(df).collect()] == [2**32]
    r = spark.createDataFrame([(1, "t", "b", 0, 2**40 - 1), (1, "t", "c", 0, None), (1, "t", "d", 5, 4)], "prefix_id bigint, tli string, name string, start_pos bigint, stop_pos bigint")
    assert {x.name: x.covered for x in continuity.backup_cover(r, df, CHUNK).collect()} == {"b": False, "c": False, "d": False}


def test_unfold(spark):
    df = spark.createDataFrame([("a", 3, 30), ("b", 7, 7), ("c", 9, 8)], "k string, lo bigint, hi bigint")
    got = sorted((r.k, r.x) for r in scale.unfold(df, "lo", "hi", "x", step=3).collect())
    assert got == [("a", i) for i in range(3, 31)] + [("b", 7)]


def test_restore_points_when_all_times_lie_in_one_second(spark):
    """Most rows belong to one prefix and many share a time: ranges are cut by rows, not by time."""
    n = 4000
    data = [(0 if k % 4 else 1, f"b{k:05}", f"k{k:05}", k % 9) for k in range(n)]
    b = spark.createDataFrame(data, "prefix_id bigint, name string, key string, us bigint").withColumn("last_modified", F.timestamp_micros("us"))
    t = spark.createDataFrame([(k, k % 3, (k * 7) % 12 - 2) for k in range(500)], "request_id bigint, prefix_id bigint, us bigint").withColumn("target", F.timestamp_micros("us"))
    got = {r.request_id: r.name for r in continuity.restore_points(b, t).collect()}
    for k in range(500):
        usable = [(us, key, name) for p, name, key, us in data if p == k % 3 and us <= (k * 7) % 12 - 2]
        assert got[k] == (max(usable)[2] if usable else None)
    with log_stream.settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        chunks = scale.range_chunks(b, ["prefix_id"], ["last_modified", "key"]).groupBy("chunk").count().collect()
    assert len(chunks) >= 4 and max(r["count"] for r in chunks) < n / 2


def test_latest_rows(spark):
    data = [(1, None, "z"), (1, 3, "a"), (1, 3, "b"), (1, 2, "c"), (2, None, "d"), (2, None, "e")]
    df = spark.createDataFrame(data, "g bigint, t bigint, k string")
    assert rows(scale.latest_rows(df, ["g"], "t", ["k"])) == [(1, 3, "b"), (2, None, "e")]
    plan = df.groupBy("g").agg(F.max("t"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
