import os

from models import rows
from pyspark.sql import functions as F

from tidemark.functions import logtext
from tidemark.operators import events
from tidemark.sinks import archive as sink
from tidemark.sources import archive as source
from tidemark.streaming import log_stream


def rendered(spark, pairs):
    df = spark.createDataFrame([(0, 1234, pairs)], "s bigint, pid bigint, pairs map<string,string>")
    return df.select(logtext.render_structured(F.timestamp_seconds("s"), "pid", "pairs").alias("t")).first().t


def test_structured_text(spark):
    head = "time=1970-01-01T00:00:00.000000-00 pid=1234"
    assert rendered(spark, {}) == head
    assert rendered(spark, {"hello": "world"}) == head + " hello=world"
    assert rendered(spark, {"hello": "world", "goodbye": "world"}) == head + " goodbye=world hello=world"


def test_record_text(spark):
    df = spark.createDataFrame([("m", "d", "h", "s"), ("m", None, "h", "s"), ("m", None, None, "s")], "m string, d string, h string, s string")
    got = [r[0] for r in df.select(logtext.render_record("m", "d", "h", "s")).collect()]
    assert got == ["MSG: m\nDETAIL: d\nHINT: h\nSTRUCTURED: s", "MSG: m\nHINT: h\nSTRUCTURED: s", "MSG: m\nSTRUCTURED: s"]


def test_parse(spark):
    df = spark.createDataFrame([("a=1 b=x=y c= a=2 junk =3",)], "t string")
    assert df.select(logtext.parse_structured("t").alias("m")).first().m == {"a": "2", "b": "x=y", "c": ""}


def test_typed_events(spark):
    lines = [
        "Jan 01 host tool[1] INFO     MSG: begin",
        "        DETAIL: There have been 4 attempts to fetch wal file s3://x/y.lzo so far.",
        "        STRUCTURED: time=2020-01-02T03:04:05.000006-00 pid=9 action=push-wal key=k prefix=p/ rate=12.5 seg=S state=complete",
        "STRUCTURED: time=broken pid=x",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = sorted(events.typed_events(df).collect(), key=lambda r: r.pid or 0)
    assert (got[1].pid, got[1].action, got[1].rate, got[1].state, got[1].time.microsecond) == (9, "push-wal", 12.5, "complete", 6)
    assert got[0].time is None and got[0].pid is None
    assert rows(events.retry_attempts(df)) == [("fetch wal file", "s3://x/y.lzo", 4, 1)]


EVENT = "s bigint, pid bigint, action string, key string, seg string, prefix string, state string, rate double"


def event(s, state, key="k", action="push-wal", seg=None, rate=None, prefix="p/"):
    return (s, 1, action, key, seg, prefix, state, rate)


def as_events(df):
    return df.select(F.timestamp_seconds(F.col("s") + 1_000_200).alias("time"), *[c for c in df.columns if c != "s"])


def test_latest_and_stats(spark):
    df = as_events(spark.createDataFrame([event(1, "begin"), event(5, "complete", rate=10.0), event(2, "begin", "j"), event(9, "skip", "j")], EVENT))
    assert sorted((r.key, r.state) for r in events.latest_states(df).collect()) == [("j", "skip"), ("k", "complete")]
    s = events.upload_stats(df).first()
    assert (s.begin, s.complete, s.skip, s.mean_rate, s.median_rate) == (2, 1, 1, 10.0, 10.0)


def stream_of(spark, tmp_path, batches, name):
    """A stream that reads the given batches one after another."""
    path = str(tmp_path / name)
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and not f.startswith("b"):
                os.utime(os.path.join(path, f), (1_000_000 + i * 10, 1_000_000 + i * 10))
                os.rename(os.path.join(path, f), os.path.join(path, f"b{i}.parquet"))
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", "1").parquet(path)
    return as_events(raw)


def test_late_rows_are_counted(spark, tmp_path):
    batches = [[event(s, "complete", rate=1.0) for s in (0, 100, 4000)], [event(8000, "complete", rate=1.0)], [event(10, "complete", rate=1.0)]]
    out, q = log_stream.run_available(log_stream.throughput(stream_of(spark, tmp_path, batches, "late")), "late")
    assert log_stream.late_rows(q) == 1
    assert out.agg(F.sum("uploads")).first()[0] == 3  # the newest window is still open


def test_pairs_over_batches(spark, tmp_path):
    batches = [
        [event(0, "begin", "a"), event(10, "begin", "b"), event(20, "begin", "c")],
        [event(60, "complete", "a"), event(5000, "skip", "b")],
        [event(20_000, "begin", "z"), event(20_001, "complete", "y")],
    ]
    out, _ = log_stream.run_available(log_stream.paired_uploads(stream_of(spark, tmp_path, batches, "pairs")), "pairs")
    got = {r.key: (r.outcome, r.duration_us) for r in out.collect()}
    assert got == {"a": ("complete", 60_000_000), "b": (None, None), "c": (None, None)}


def test_missing_successor_in_any_order(spark, tmp_path):
    def s(n):
        return f"00000001{n // 256:08X}{n % 256:08X}"

    batches = [
        [event(0, "complete", "a", seg=s(254)), event(5, "complete", "b", seg=s(256))],
        [event(9, "complete", "c", seg=s(255)), event(10, "complete", "d", seg=s(258)), event(11, "complete", "e", seg=s(259))],
        [event(90_000, "complete", "z", seg=s(900))],
    ]
    out, _ = log_stream.run_available(log_stream.missing_successors(stream_of(spark, tmp_path, batches, "gaps")), "gaps")
    assert sorted(r.missing for r in out.collect()) == [s(257), s(260)]


def test_repeats_are_dropped(spark, tmp_path):
    batches = [[event(0, "complete", seg="s1"), event(1, "complete", seg="s2")], [event(30, "complete", seg="s1")]]
    out, _ = log_stream.run_available(log_stream.first_pushes(stream_of(spark, tmp_path, batches, "dups")), "dups")
    assert sorted(r.seg for r in out.collect()) == ["s1", "s2"]


def test_sessions(spark, tmp_path):
    batches = [[event(0, "begin", action="wal-fetch"), event(100, "begin", action="wal-fetch")], [event(2000, "begin", action="wal-fetch"), event(50_000, "begin", action="wal-fetch")]]
    out, _ = log_stream.run_available(log_stream.restore_sessions(stream_of(spark, tmp_path, batches, "sess")), "sess")
    assert sorted(r.fetches for r in out.collect()) == [1, 2]


def test_log_files(spark, tmp_path):
    df = spark.createDataFrame([(0, 7, {"action": "push-wal", "state": "skip"}, "m", None, "h")], "s bigint, pid bigint, pairs map<string,string>, msg string, detail string, hint string")
    df = df.withColumn("time", F.timestamp_seconds("s"))
    path = str(tmp_path / "log")
    sink.write_log(df, path)
    assert source.read_log(spark, path).count() == 3 == sink.log_lines(df).count()
    assert events.typed_events(source.read_log(spark, path)).first().state == "skip"
    out, _ = log_stream.run_available(events.typed_events(source.stream_log(spark, path)), "files")
    assert out.first().pid == 7
