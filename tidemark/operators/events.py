"""Questions to the archive log, as a batch table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import scale
from tidemark.functions import fixed, logtext, names


FIELDS = ("time", "pid", "action", "key", "seg", "prefix", "state", "rate")


def typed_events(lines: DataFrame, column="value", fields=FIELDS) -> DataFrame:
    """Typed events out of log lines (batch or stream); lines without a structured part drop out.

    Only the `fields` asked for are looked up in the text.
    """
    s = lines.where(F.col(column).contains("STRUCTURED: ")).select(
        *[c for c in lines.columns if c != column], logtext.structured_part(column).alias("_text")
    )
    found = s.where("_text is not null")

    def get(k):
        return logtext.structured_value("_text", k)

    typed = {"time": names.parse_log_time, "pid": lambda c: c.try_cast("bigint"), "rate": lambda c: c.try_cast("double")}
    return scale.once(found, *[typed.get(f, lambda c: c)(get(f)).alias(f) for f in fields]).drop("_text")


def typed_records(records: DataFrame, fields=FIELDS) -> DataFrame:
    """One event per whole record (column `record`): the typed fields with msg, detail and hint."""
    parts = logtext.record_parts("record")
    rest = [c for c in records.columns if c != "record"]
    found = scale.once(records, *[parts[p].alias(p) for p in ("msg", "detail", "hint", "structured")])
    lines = found.select(*rest, "msg", "detail", "hint", F.concat(F.lit("STRUCTURED: "), "structured").alias("value"))
    return typed_events(lines, fields=fields)


def event_pairs(lines: DataFrame, column="value") -> DataFrame:
    """All pairs of each structured line as a map, for keys without a column of their own."""
    text = logtext.structured_part(column)
    return lines.where(F.col(column).contains("STRUCTURED: ") & text.isNotNull()).select(
        logtext.parse_structured(text).alias("pairs")
    )


def upload_stats(events: DataFrame) -> DataFrame:
    """Outcomes and rates of segment uploads per prefix."""
    push = events.where(F.col("action") == fixed.ACTION_PUSH)
    counts = [F.count_if(F.col("state") == s).alias(s) for s in fixed.STATES]
    rate = F.when(F.col("state") == "complete", F.col("rate"))
    return push.groupBy("prefix").agg(
        *counts,
        F.avg(rate).alias("mean_rate"),
        F.percentile_approx(rate, 0.5, 10000).alias("median_rate"),
        F.percentile_approx(rate, 0.95, 10000).alias("p95_rate"),
    )


def retry_attempts(lines: DataFrame, column="value") -> DataFrame:
    """Highest number of attempts reported for each object."""
    a = lines.where(F.col(column).contains("There have been ")).select(logtext.attempts(column).alias("a"))
    return (
        a.where("a is not null")
        .groupBy(F.col("a.what").alias("what"), F.col("a.object").alias("object"))
        .agg(F.max("a.n").alias("attempts"), F.count(F.lit(1)).alias("messages"))
    )


def latest_states(events: DataFrame) -> DataFrame:
    """Last state of each (prefix, key); equal times are settled by pid and state."""
    stated = events.where("state is not null")
    return scale.latest_rows(stated.select("prefix", "key", "time", "pid", "state"), ["prefix", "key"], "time", ["time", "pid", "state"])
