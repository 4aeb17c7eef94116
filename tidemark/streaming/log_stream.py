"""Structured Streaming over the archive log.

Every function takes a streaming (or batch) DataFrame of typed events and returns
one; `run_available` drives a stream over what is there and sinks it to files.
State is keyed by single uploads, segments or windows, so a busy prefix is spread
over all tasks. Sessions are keyed by prefix alone; Spark merges them inside each
task before the shuffle, so a busy prefix sends few rows.
"""

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed, names
from tidemark.session import shared_path

WATERMARK = "1 hour"


def with_event_time(events: DataFrame, delay=WATERMARK) -> DataFrame:
    return events.withWatermark("time", delay)


def paired_uploads(events: DataFrame, delay=WATERMARK, within="10 minutes") -> DataFrame:
    """Each `begin` with the `complete` or `skip` that follows it within the bound; null where none came.

    The key is (prefix, pid, key) of one upload.
    """
    push = events.where(F.col("action") == fixed.ACTION_PUSH)
    begun = (
        push.where("state = 'begin'")
        .select("prefix", "pid", "key", F.col("time").alias("begin_time"))
        .withWatermark("begin_time", delay)
    )
    ended = (
        push.where("state in ('complete', 'skip')")
        .select(
            F.col("prefix").alias("e_prefix"),
            F.col("pid").alias("e_pid"),
            F.col("key").alias("e_key"),
            F.col("time").alias("end_time"),
            F.col("state").alias("outcome"),
        )
        .withWatermark("end_time", delay)
    )
    bound = (
        (F.col("prefix") == F.col("e_prefix"))
        & (F.col("pid") == F.col("e_pid"))
        & (F.col("key") == F.col("e_key"))
        & (F.col("end_time") >= F.col("begin_time"))
        & (F.col("end_time") <= F.col("begin_time") + F.expr(f"interval {within}"))
    )
    return begun.join(ended, bound, "leftOuter").select(
        "prefix",
        "pid",
        "key",
        "begin_time",
        "outcome",
        (F.unix_micros("end_time") - F.unix_micros("begin_time")).alias("duration_us"),
    )


def stuck_uploads(events: DataFrame, delay=WATERMARK, within="10 minutes") -> DataFrame:
    """Uploads that began and did not end within the bound."""
    return paired_uploads(events, delay, within).where("outcome is null").select("prefix", "pid", "key", "begin_time")


def throughput(events: DataFrame, delay="10 minutes", width="5 minutes", slide=None) -> DataFrame:
    """Finished uploads and their rates per prefix in tumbling (or sliding) windows."""
    done = events.where((F.col("action") == fixed.ACTION_PUSH) & (F.col("state") == "complete"))
    window = F.window("time", width, slide) if slide else F.window("time", width)
    return (
        done.withWatermark("time", delay)
        .groupBy(window.alias("w"), "prefix")
        .agg(F.count(F.lit(1)).alias("uploads"), F.sum("rate").alias("rate_sum"), F.max("rate").alias("rate_max"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "prefix", "uploads", "rate_sum", "rate_max")
    )


def missing_successors(events: DataFrame, delay=WATERMARK, within="1 hour") -> DataFrame:
    """Live gap alarm: archived segments whose successor on the same timeline did not show up in time.

    An arrival is matched with that of the next position, in either order, within
    the bound; what stays unmatched once the watermark has passed is the low end of a
    gap (or of a stalled archive). State is keyed by single segments: arrivals out
    of order are normal with parallel pushes, and no task holds a whole prefix.
    """
    s = names.parse_segment("seg")
    arrived = events.where(
        (F.col("action") == fixed.ACTION_PUSH) & F.col("state").isin("complete", "skip") & s.isNotNull()
    ).select("prefix", s["tli"].alias("tli"), names.position(s["log"], s["seg"]).alias("pos"), "time", "seg")
    low = arrived.select("prefix", "tli", "pos", F.col("time").alias("low_time"), "seg").withWatermark("low_time", delay)
    high = arrived.select(
        F.col("prefix").alias("h_prefix"),
        F.col("tli").alias("h_tli"),
        (F.col("pos") - 1).alias("h_pos"),
        F.col("time").alias("high_time"),
    ).withWatermark("high_time", delay)
    bound = (
        (F.col("prefix") == F.col("h_prefix"))
        & (F.col("tli") == F.col("h_tli"))
        & (F.col("pos") == F.col("h_pos"))
        & (F.col("high_time") >= F.col("low_time") - F.expr(f"interval {within}"))
        & (F.col("high_time") <= F.col("low_time") + F.expr(f"interval {within}"))
    )
    return (
        low.join(high, bound, "leftOuter")
        .where("h_pos is null")
        .select("prefix", "tli", "seg", "low_time", F.concat("tli", names.sn_of_position(F.col("pos") + 1)).alias("missing"))
    )


def first_pushes(events: DataFrame, delay=WATERMARK) -> DataFrame:
    """One row per (prefix, seg): parallel pushes may report a segment more than once."""
    push = events.where((F.col("action") == fixed.ACTION_PUSH) & F.col("seg").isNotNull())
    return push.withWatermark("time", delay).dropDuplicatesWithinWatermark(["prefix", "seg"])


#: Sessions of one prefix are merged inside each task before the shuffle.
SESSION_SETTINGS = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def restore_sessions(events: DataFrame, delay=WATERMARK, pause="10 minutes") -> DataFrame:
    """Runs of segment fetches per prefix, split where none came for `pause`."""
    fetch = events.where(F.col("action") == fixed.ACTION_FETCH)
    return (
        fetch.withWatermark("time", delay)
        .groupBy(F.session_window("time", pause).alias("w"), "prefix")
        .agg(F.count(F.lit(1)).alias("fetches"))
        .select("prefix", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "fetches")
    )


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict):
    """Session settings that hold while a query starts and runs; afterwards they are what they were."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, name: str, mode="append", folder=None, wanted=None):
    """Drive a stream over everything available now into parquet; returns (table, query).

    Output and progress lie in the shared folder, so a lost executor, or the driver
    itself, can pick the query up again; pass the `folder` of an earlier run to go on
    from there. `wanted` are settings the query needs; the session's own come back afterwards.
    """
    spark: SparkSession = stream.sparkSession
    folder = folder or shared_path(spark, f"stream-{name}")
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/progress")
    with settings(spark, wanted or {}):
        query = writer.trigger(availableNow=True).start(f"{folder}/data")
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data"), query


def late_rows(query) -> int:
    """Rows a finished query dropped because they were older than its watermark."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)
